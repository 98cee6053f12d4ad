"""Files in and out, streams, damage, and what queries over tables don't reach."""

import time

import pytest
from pyspark.sql import functions as F

from foliospark.functions import native as N
from foliospark.kernels import fonts
from foliospark.kernels.canvas import Canvas
from foliospark.kernels.importer import structural_hash
from foliospark.kernels.objects import Ref, Stream
from foliospark.kernels.writer import Builder
from foliospark.operators import build as B
from foliospark.operators import documents as D
from foliospark.plans import golden
from foliospark.sources import pdf
from foliospark.streaming.ingest import page_stream


def one_page(text: str) -> bytes:
    b = Builder()
    Canvas(b).text(10, 10, text).page((0, 0, 200, 100))
    return b.save()


def test_files_of_any_id(spark, tmp_path):
    rows = [("a/b", one_page("x")), ("..", one_page("y")), ("é %", one_page("z"))]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "doc_id string, content binary")
    for _ in range(2):  # a second run writes the same files
        pdf.write_files(df, f"file://{tmp_path}")
    assert sorted(f.name for f in tmp_path.iterdir() if f.is_file()) == ["%2E..pdf", "%C3%A9%20%25.pdf", "a%2Fb.pdf"]
    texts = D.render_events(pdf.read_files(spark, f"file://{tmp_path}")).select("text").collect()
    assert sorted(r.text for r in texts) == ["x", "y", "z"]


def test_data_source_packs_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pdf, "PARTITION_BYTES", 2000)
    for k in range(9):
        (tmp_path / f"{k}.pdf").write_bytes(one_page(str(k)))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    parts = pdf.PdfReader(f"file://{tmp_path}").partitions()
    assert 1 < len(parts) < 10 and sum(len(p.paths) for p in parts) == 10
    pdf.register(spark)
    got = spark.read.format("pdf").load(f"file://{tmp_path}").collect()
    assert sorted((r.page_no, r.width, r.height) for r in got) == [(1, 200.0, 100.0)] * 9


def test_page_stream(spark, tmp_path):
    source, checkpoint = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    (source / "1.pdf").write_bytes(one_page("a"))

    def run() -> int:
        pages = page_stream(spark, f"file://{source}").select("doc_id", "page_no")
        q = pages.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 1 and run() == 1  # nothing new, nothing more
    time.sleep(1.1)
    (source / "2.pdf").write_bytes(one_page("b"))
    assert run() == 2


def test_damage_is_told(spark):
    broken = golden.assembled({**golden.BASIC, 4: golden.stream(b"xx", b"/Filter/JPXDecode")})
    rows = [("good", one_page("a")), ("image codec", broken), ("nothing", b""), ("null", None)]
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "doc_id string, content binary")
    errors = {r.doc_id: r.error for r in D.content_errors(df).collect()}
    assert errors == {"image codec": "unsupported filter"}
    facts = {r.doc_id: r.parse_error for r in D.pdf_docs(df).collect()}
    assert facts["good"] is None and facts["nothing"] and facts["null"]


def test_structural_hash_of_shared_and_cyclic_graphs():
    objects = {k: {"A": Ref(k + 1), "B": Ref(k + 1)} for k in range(1, 60)} | {60: 7, 70: {"X": Ref(71)}, 71: {"Y": Ref(70)}, 72: [Ref(60), Ref(70)]}
    get = lambda x: objects[x.num] if isinstance(x, Ref) else x
    began = time.perf_counter()
    assert structural_hash(Ref(1), get) and time.perf_counter() - began < 1
    assert structural_hash(Ref(72), get) is None and structural_hash(Ref(71), get, {}) is None
    assert structural_hash(Stream({"A": 1, "Length": 3}, b"abc"), get) == structural_hash(Stream({"Length": Ref(60), "A": 1}, b"abc"), get)


def test_merge_order_and_equal_streams(spark):
    same, rows = one_page("same"), []
    for k in range(40):
        rows.append((k % 2, k, bytearray(same if k % 4 else one_page(f"own {k}"))))
    df = spark.createDataFrame(rows, "key bigint, place int, content binary")
    merged = B.merge(df, "key", "place")
    texts = D.render_events(merged).orderBy("doc_id", "page_no").groupBy("doc_id").agg(F.collect_list("text").alias("t")).collect()
    want = {j: [("same" if k % 4 else f"own {k}") for k in range(40) if k % 2 == j] for j in (0, 1)}
    assert {r.doc_id: r.t for r in texts} == want
    streams = D.cos_objects(merged).where("kind = 'stream'").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in streams} == {0: 11, 1: 1}


@pytest.mark.parametrize("font", fonts.STANDARD)
def test_native_width_is_the_kernels(spark, font):
    texts = ["", "Hello", "Àéîß", "—…€™", "Ω漢x\n\t", "\x81\x9f\xa0"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(N.text_width(F.col("t"), font, 10).alias("w")).collect()
    assert [r.w for r in got] == pytest.approx([fonts.text_width(t, font, 10) for t in texts])
