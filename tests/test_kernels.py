"""Kernels: results that speed must not change, and bounds on their time."""

import time

import numpy as np
import pytest

import __spark_entry__

from foliospark.kernels import document, qr
from foliospark.kernels.canvas import Canvas
from foliospark.kernels.document import Document
from foliospark.kernels.syntax import Reader
from foliospark.kernels.writer import Builder
from foliospark.plans import golden


def blocks(version, level):
    return qr._blocks[level][version - 1], qr._ec[level][version - 1]


def plain_penalty(m):
    """The rules as written, module by module."""
    out, n = 0, len(m)
    for line in ["".join("01"[v] for v in row) for lines in (m, m.T) for row in lines.tolist()]:
        runs = [len(run) for run in line.replace("01", "0 1").replace("10", "1 0").split()]
        out += sum(r - 2 for r in runs if r >= 5)
        out += 40 * sum(line[k : k + 11] in ("10111010000", "00001011101") for k in range(n - 10))
    out += 3 * sum(len({m[y, x], m[y, x + 1], m[y + 1, x], m[y + 1, x + 1]}) == 1 for y in range(n - 1) for x in range(n - 1))
    return out + 10 * (abs(int(m.sum()) * 20 - n * n * 10) // (n * n))


def test_penalty_by_the_rules():
    rng = np.random.default_rng(2)
    shapes = [rng.random((n, n)) < share for n in (21, 25, 57) for share in (0.05, 0.5, 0.9)]
    shapes += [qr.matrix("1011101", level) for level in "LMQH"] + [np.zeros((21, 21), bool), np.ones((21, 21), bool)]
    for m in shapes:
        assert qr.penalty(m) == plain_penalty(m)


def test_symbols_are_written_and_read_in_time():
    began = time.process_time()
    for k in range(400):
        text = f"some part name {k}" if k % 2 else f"{k}" + "7" * (k % 50 * 8)
        symbol = qr.rows(text, "LMQH"[k % 4])
        assert golden.read_qr(symbol, blocks) == text
    assert time.process_time() - began < 2.5
    wrong = [*symbol[:-1], symbol[-1][:-1] + "10"[int(symbol[-1][-1])]]
    with pytest.raises(ValueError, match="syndrome"):
        golden.read_qr(wrong, blocks)


def one_page(text):
    b = Builder()
    Canvas(b).text(72, 700, text).page()
    return b.save()


def test_equal_objects_are_parsed_once_and_belong_to_their_document():
    document._parsed.cache_clear()
    a, b = Document(one_page("one")), Document(one_page("two"))
    page = a.pages()[0].dict
    page["MediaBox"].append("changed")
    page["Resources"]["Font"].clear()
    assert b.pages()[0].dict["MediaBox"] == [0, 0, 612, 792] and b.pages()[0].resources["Font"]
    assert document._parsed.cache_info().hits >= 3
    assert Document(one_page("three")).pages()[0].content() == Document(one_page("three")).pages()[0].content()


@pytest.mark.parametrize(
    "body", [b"<</A (endobj) /B (x stream y)>>", b"<</A 1 %endobj\n/B 2>>", b"[(a) (endobj", b"<</A [1 2", b"<</streamed /x>>", b"[1 0 R 2 0 Rx 3 +4 0 R]", b"<</A true/B null/C false>>"]
)
def test_objects_that_hold_what_ends_objects(body):
    """Whatever is found by searching for an object's end, it is read as without a search."""
    d = Document(b"%PDF-1.4\n1 0 obj\n" + body + b"\nendobj\n2 0 obj\n<</Type /Catalog>>\nendobj\ntrailer\n<</Root 2 0 R>>\n")
    for _ in range(2):
        assert repr(d._at(9, 1)) == repr(Reader(d.data, 17).object())


def test_tables_of_any_rows():
    good = one_page("x")
    wide = good.replace(b" 00000 n \n", b" 00000  n\n")
    for data in (good, wide, good.replace(b" n \n", b" n\r\n")):
        d = Document(data)
        assert not d.recovered and len(d.entries) == 5 and d.entries[1].offset == 15 and d.entries[0].kind == 0


def test_reachable_objects_makes_its_documents_once(spark, sf):
    plan = __spark_entry__.queries()["reachable_objects"](spark, sf)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
