import io
import zipfile

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import documents as D
from folioflow.operators import relational as R
from folioflow.operators import retrieval as V
from folioflow.operators import rules as U
from folioflow.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.tokens(F.lit("The Plan-9, a plan"))) == ["plan", "plan"]
    assert one(spark, T.bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == ["a_b", "b_c"]
    assert one(spark, T.sentences(F.lit("One two. Three?\n\nFour"))) == ["One two.", "Three?", "Four"]
    assert one(spark, T.sentences(F.lit("a. 1 b.  2 c"))) == ["a.", "1 b.", "2 c"]
    assert one(spark, T.collapse(F.lit(" a  b\n"))) == "a b"
    assert one(spark, T.safe_path(F.lit("a/../b:c//d "))) == "a/b c/d"
    assert one(spark, T.html_text(F.lit("<p>a&amp;b<script>x</script></p>"))) == "a&b"
    assert one(spark, T.host_allowed(F.lit("https://x.example.org/a"), ["example.org"])) is True
    assert one(spark, T.host_allowed(F.lit("https://badexample.org"), ["example.org"])) is False
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_grade_needs_an_unbroken_chain(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, U.grade([t, t, f, t, t])) == "D"
    assert one(spark, U.grade([f, t, t, t, t])) is None
    assert one(spark, U.grade([t] * 5)) == "A"


def test_diverse_takes_skipped_items_last(spark):
    df = spark.createDataFrame([(1, i, 10 + i, "a" if i < 4 else "b") for i in range(1, 6)], "doc_id long, rank int, item_id long, g string")
    got = V.diverse(df, 4, "g", share=0.5, most=2).orderBy("place").collect()
    assert [r.item_id for r in got] == [11, 12, 14, 15]


def test_diverse_equals_plain_greedy(spark):
    def greedy(ranked, k):
        if len(ranked) <= k:
            return ranked
        taken = []
        for i in ranked:
            if sum(j % 5 == i % 5 for j in taken) < 2 and sum(j % 5 % 2 == i % 5 % 2 for j in taken) < 4 and len(taken) < k:
                taken.append(i)
        return (taken + [i for i in ranked if i not in taken])[:k]

    items = {1: [*range(0, 250, 5), 1, 2, 3], 2: [0, 5, 10, 1], 3: [0, 2, 4, 5, 7, 9, 1, 3, 6, 8, 11], 4: list(range(30, 0, -1))}
    df = spark.createDataFrame([(d, r, i, i % 5, i % 5 % 2) for d, own in items.items() for r, i in enumerate(own, 1)], "doc_id long, rank int, item_id long, kind long, wider long")
    got = {d: [] for d in items}
    for r in V.diverse(df, 10, "kind", wider="wider").orderBy("doc_id", "place").collect():
        got[r.doc_id].append(r.item_id)
    assert got == {d: greedy(own, 10) for d, own in items.items()}


def test_natural_key_compares_numbers_of_any_length(spark):
    names = ["a2", "a10", "a" + "9" * 18, "a1" + "0" * 18, "a1" + "0" * 17 + "1", "a" + "1" * 30]
    df = spark.createDataFrame([(x,) for x in reversed(names)], "x string")
    assert [r.x for r in df.orderBy(T.natural_key(F.col("x"))).collect()] == sorted(names, key=lambda x: int(x[1:]))
    assert one(spark, T.natural_key(F.lit("a007"))) == one(spark, T.natural_key(F.lit("a7")))


def test_upsert_and_versions(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id long, v long, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "id long, v long, x string")
    assert {(r.id, r.x) for r in R.upsert(old, new, ["id"], "v").collect()} == {(1, "c"), (2, "b"), (3, "e")}


def test_long_lines_become_segments(spark):
    df = spark.createDataFrame([(1, "x" * 45 + "\n\ny"), (2, None)], "doc_id long, text string")
    got = [(r.doc_id, r.line, r.part, len(r.text), r.status) for r in D.units(df, 20).orderBy("doc_id", "line", "part").collect()]
    assert got == [(1, 0, 0, 20, "processed"), (1, 0, 1, 20, "processed"), (1, 0, 2, 5, "processed"), (1, 1, 0, 0, "empty"), (1, 2, 0, 1, "processed"), (2, 0, 0, 0, "empty")]


def test_office_and_text_files_become_units(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<d xmlns:w="w"><w:p><w:t>Hello</w:t></w:p><w:p><w:t>you</w:t></w:p></d>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.txt").write_bytes("é\nx".encode("cp1252"))
    got = {(r.unit_type, r.ordinal, r.text) for r in files.file_units(files.binaries(spark, str(tmp_path))).collect()}
    assert got == {("block", 0, "Hello"), ("block", 1, "you"), ("line", 0, "é"), ("line", 1, "x")}


def test_upload_findings(spark):
    df = spark.createDataFrame([("a.pdf", bytearray(b"text")), ("b.txt", bytearray(b"")), ("c.txt", bytearray(b"a\0b"))], "name string, content binary")
    got = {(r.name, r.finding) for r in D.upload_findings(df, 100).collect()}
    assert {("a.pdf", "signature_mismatch"), ("b.txt", "empty"), ("c.txt", "nul_bytes")} <= got


def test_intake_judges_each_file_by_its_id(spark):
    rows = [(1, "a.txt", b""), (2, "a.txt", b"fine"), (3, "b.pdf", b"no pdf"), (None, "a.txt", b"fine")]
    df = spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in rows], "id long, name string, content binary")
    assert {r.id: r.route for r in D.intake(df, "id", 100).collect()} == {1: "blocked", 2: "accepted", 3: "blocked", None: "accepted"}


def test_fusion_ranks_every_positive_score(spark):
    rows = [(1, i, 1.0 / (i + 1), 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, item_id long, a double, b double")
    rrf = {r.item_id: r.rrf for r in V.fuse(df, ["a", "b"]).collect()}
    assert all(abs(rrf[i] - 1 / (61 + i) / (2 / 61)) < 1e-6 for i in range(30))
    cut = {r.item_id: r.rrf for r in V.fuse(df, ["a", "b"], 20).collect()}
    assert cut[19] > 0 and cut[20] == 0
