"""Documents that share all bytes but their content: what is equal is read and written once, and nothing else changes."""

import random

import pytest

from foliospark.kernels import canvas as K
from foliospark.kernels import content, document, importer, syntax, writer
from foliospark.kernels.document import Document
from foliospark.kernels.objects import Name, PdfString, Stream
from foliospark.kernels.syntax import END, Reader
from foliospark.kernels.writer import Builder, Template
from foliospark.operators import documents as D


def line(k, flag="R", more=False):
    b = Builder()
    layer = K.layer(b, flag)
    c = K.Canvas(b)
    c.text(72, 700, f"{k}/1").begin_layer(layer).text(72, 650, f"qty {k % 50}").rectangle(10, 10, k % 50, 5).fill().end_layer()
    if more:
        c.annotations.append(K.text_annotation((1, 1, 2, 2), "note"))
    c.page()
    return b.save()


LINES = [line(k, "RAN"[k % 3]) for k in range(1, 301)]


@pytest.fixture
def calls(monkeypatch):
    """Counts of calls, by the name of what is called."""
    seen = {}

    def count(owner, name):
        real = getattr(owner, name)

        def run(*args, **kw):
            seen[name] = seen.get(name, 0) + 1
            return real(*args, **kw)

        monkeypatch.setattr(owner, name, run)

    count(syntax.Reader, "object")
    count(writer, "value_bytes")
    count(importer, "structural_hash")
    count(document.Document, "_table")
    return seen


def events(data, **kw):
    d = D._open(data)
    return list(D.event_rows(d, d.pages(), **kw))


def test_template_writes_what_save_does():
    for text in ("", "x", "(a\\)", "long enough to be deflated, long enough to be deflated"):
        b = Builder()
        c = K.Canvas(b)
        c.begin_text().font("Courier", 9).raw(K.MARK).end_text()
        t = Template(b, b.get(c.page())["Contents"], K.MARK)
        b = Builder()
        K.Canvas(b).begin_text().font("Courier", 9).show(text).end_text().page()
        assert t.fill(K.shown(text)) == b.save()
        with pytest.raises(ValueError, match="pieces"):
            t.fill()
    b = Builder()
    first = b.add_page(resources={})
    b.add_page(content=b"q Q")
    t = Template(b, b.get(first)["Contents"])  # objects behind it move
    b.put(b.get(first)["Contents"], Stream({}, b"BT ET " * 20))
    assert t.fill(b"BT ET " * 20) == b.save()


def test_line_documents_are_assembled(calls):
    from foliospark.plans import queries

    made = [queries._line_template("RAN"[k % 3]).fill(K.shown(f"{k}/1"), K.shown(f"qty {k % 50}"), K.operation("re", 10, 10, k % 50, 5)) for k in range(1, 301)]
    assert calls.get("value_bytes", 0) < 300
    assert made == LINES


def test_marked_content_text_parses_equal_lines_once(calls):
    rows = [events(x, columns=["kind", "tags"]) for x in LINES]
    assert calls.get("object", 0) < 300 * 4 and calls.get("_table", 0) < 20
    assert rows[0] == [("text", []), ("text", [{"role": "OC", "props": "A"}]), ("path", [{"role": "OC", "props": "A"}])]


def test_path_paint_counts_makes_only_the_columns_named(calls):
    rows = [events(x, columns=["kind", "paint_op", "subpaths"])[2] for x in LINES]
    assert calls.get("object", 0) < 300 * 4
    assert [r[2][0]["pts"][1]["x"] - 10 for r in rows] == [k % 50 for k in range(1, 301)]


def test_op_histogram_names_only_operators(spark):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(LINES[:9])], "doc_id int, content binary")
    ops = D.content_ops(docs, ["op"])
    assert ops.columns == ["doc_id", "op"]
    assert ops.select("op").collect() == D.content_ops(docs).select("op").collect()


def test_flatten_layers_writes_the_rest_once(spark, calls):
    from foliospark.operators import build as B

    hidden = lambda layer: layer == "R"
    d = [Document(x, shared=True) for x in LINES]
    known = [B._flat_template(x) for x in d]
    calls.clear()
    flat = [t.fill(content.flatten_layers(x.pages()[0].content(), names, hidden)) for x, (t, names) in zip(d, known)]
    assert calls.get("value_bytes", 0) == 0
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(LINES)], "doc_id int, content binary")
    assert [r.content for r in B.flatten_layers(docs, hidden).orderBy("doc_id").collect()] == flat
    b = Builder(Document(LINES[0]))
    page = b.source.pages()[0]
    b.objects[page.num] = {**page.dict, "Contents": b.add(Stream({}, content.flatten_layers(page.content(), {"L0": "A"}, hidden)))}
    assert flat[0] == b.save()


@pytest.mark.parametrize("packed", [False, True])
def test_page_count_merge_and_objstm_equivalence(calls, packed):
    """What is merged by notation is what is merged by value; objects of a group are written by few calls."""
    damaged = LINES[4].replace(b"startxref", b"startxxxx")
    for group in (LINES[:1], LINES[:7], [*LINES[:3], line(9, more=True), LINES[0], damaged]):
        target = Builder()
        i = importer.Importer(target)
        for data in group:
            for page in Document(data).pages():
                i.page(page)
        assert importer.merge(group, object_streams=packed) == target.save(packed)
    calls.clear()
    merged = [importer.merge(LINES[k : k + 4], object_streams=packed) for k in range(0, 300, 4)]
    assert calls.get("value_bytes", 0) < 300 * 14
    calls.clear()
    assert [len(D._open(x).pages()) for x in merged] == [4] * 75
    assert calls.get("object", 0) < 300 * 4


def test_merged_contents_keeps_equal_streams_once(calls):
    merged = Document(importer.merge([*LINES[:5], *LINES[:5], line(300)]))
    streams = [x for n in merged.entries if isinstance(x := merged.object(n), Stream)]
    assert len(streams) == 6
    assert not calls.get("structural_hash")


def test_form_nup_takes_deflated_content_as_it_is():
    merged = importer.merge(LINES[:6])
    own = [x.raw for n in Document(merged).entries if isinstance(x := Document(merged).object(n), Stream)]
    sheets = Document(importer.impose([merged], 2, 2))
    forms = [x for n in sheets.entries if isinstance(x := sheets.object(n), Stream) and x.dict.get("Subtype") == "Form"]
    assert sorted(x.raw for x in forms) == sorted(own)
    assert len(sheets.pages()) == 2 and [e[4] for p in sheets.pages() for e in D.event_rows(sheets, [p]) if e[3] == "text"][::2] == [f"{k}/1" for k in range(1, 7)]


def test_shapes_hold_only_what_their_bytes_say():
    good = LINES[0]
    for data in (good, good.replace(b"startxref", b"startxxxx"), good.replace(b"0000000184", b"0000000185"), good.replace(b"/Contents 5 0 R", b"/Contents 4 0 R"), good.replace(b"[4 0 R]", b"[5 0 R]"),
                 good.replace(b"(A)>>\nendobj", b"(A)>>      "), good.replace(b"/Root 1 0 R", b"/Root 5 0 R"), good.replace(b"/Root 1", b"/Prev 0/Root 1"), good[:-30], good + b"\n%more"):
        a, b = Document(data), D._open(data)
        assert (a.recovered, a.entries, a.listed, a.trailer, a.max_object) == (b.recovered, b.entries, b.listed, b.trailer, b.max_object)
        assert [a.object(n) for n in a.entries] == [b.object(n) for n in b.entries]
        assert [(p.num, p.dict, p.inherited, p.content()) for p in a.pages()] == [(p.num, p.dict, p.inherited, p.content()) for p in b.pages()]
    assert D._open(good).shape and D._open(good).shape is D._open(LINES[3]).shape


def test_lines_read_alone_say_what_they_say_in_place():
    words = b"q|Q|/F0 12 Tf|(a) Tj|(a\\)b) Tj|[(x) 3] TJ|10 10 17.5 5 re|f|/X BMC|/P <</A 1>> BDC|EMC|% note Tj|1 2|BI /W 2 /H 3 ID xx EI|(two\nlines) Tj|12 0|R|--3 w|true 1 w|(un|]|>>|\r|  5 w  |/ Do|(ab)Tj|5 0 R 1 w".split(b"|")
    r = random.Random(1)

    def plain(data):
        reader, operands = Reader(data), []
        while (x := reader.object()) is not END:
            if isinstance(x, syntax.Keyword):
                if x == b"BI":
                    operands.append(content.inline_image(reader))
                yield bytes(x), operands, reader.pos
                operands = []
            else:
                operands.append(x)

    for _ in range(3000):
        data = r.choice([b"\n", b"\n", b" ", b"\r\n"]).join(r.choice(words) for _ in range(r.randrange(1, 9)))
        want = list(plain(data))
        assert [(op, list(args), end) for op, args, _, end, _, _ in content.operators(data)] == want
        assert [(op, list(args)) for op, args, *_ in content.program(data)] == [x[:2] for x in want]
    assert [op for op, *_ in content.program(b"(a) Tj\n/N BMC")] == [b"Tj", b"BMC"]
    assert next(iter(content.program(b"(a) Tj")))[1] == (PdfString(b"a"),) and isinstance(next(iter(content.program(b"/N BMC")))[1][0], Name)
