import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from qanat.llm import fill_middle as M
from qanat.llm import queries
from tests.compare import connect, difference

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
PIECES = [" ", "\n", "\t", "a", "bc", "é", "漢", "😀", "<", "P", ">", "<S", "  ", "\x1f", " "]


def marked(text):
    return any(m in text for m in ("<P>", "<S>", "<M>"))


def brute(key, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or marked(text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def reader(frames):
    return M.Reader([dict(zip(("units", "chars", "bytes", "data"), f, strict=True)) for f in frames])


@pytest.mark.parametrize("size", [4, 7, 16, 64])
def test_frames_units_and_round_trips_across_frame_ends(monkeypatch, size):
    monkeypatch.setattr(M, "FRAME_BYTES", size)
    rng = random.Random(size)
    for _ in range(400):
        text = "".join(rng.choices(PIECES, k=rng.randrange(60)))
        r, units = reader(M.framed([text.encode()])), UNIT.findall(text)
        assert (r.units[-1] if r.units else 0) == len(units)
        assert b"".join(r.read(0, r.size)).decode() == text
        assert all(len(r.frame(k)) <= size + 3 and r.frame(k).decode() for k in range(len(r.frames)))
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert r.unit(u) == (len(before.encode()), len(before))
        if marked(text):
            continue
        for form in ("psm", "spm", "plain"):
            a, b = sorted(rng.choices(range(len(units) + 1), k=2))
            out = reader(M.framed(M.arranged(r, form, r.unit(a)[0], r.unit(b)[0])))
            assert b"".join(M.rebuilt(out, form)).decode() == text


def test_a_cut_opens_one_frame(monkeypatch):
    monkeypatch.setattr(M, "FRAME_BYTES", 100)
    r = reader(M.framed(["word ".encode() * 1_000]))
    opened = []
    unpack, r.unpack = r.unpack, lambda data: opened.append(1) or unpack(data)
    assert len(r.frames) == 50 and r.unit(617) == (617 * 5 - 1, 617 * 5 - 1) and len(opened) == 1


def test_rows_of_every_kind(spark):
    long = " ".join(f"wörter{i}" for i in range(60_000))
    texts = [None, "", " ", "\n\n", "x", " lead", "trail \n", "a <P> b", "<S", "< P>", "one two three four", "漢字 かな", long, "x" * 400_000, "nul\x00 byte"]
    rows = [(i, t, "mine", "mine", "mine") for i, t in enumerate(texts * 4)] + [(None, "no key here", "", "", "")] + [(3, "again the same", "", "", "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, frames string, form string, n string")
    found = M.transform(docs, rate=90, spm=50)
    assert {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output"} <= set(found.columns)
    found = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", M.text_of("output").alias("o"), M.text_of(M.restored()).alias("t"), M.digest("output").alias("h"))
    got = sorted(map(tuple, found.collect()), key=repr)
    want = []
    for key, text, *_ in rows:
        row = brute(key, text, 90, 50)
        want.append((key, *row, text or "", hashlib.sha256(row[-1].encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert M.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert difference(queries.op12_fill_middle(spark, path), connect(path), queries.OP12_SQL) is None


def test_no_shuffle(spark):
    plan = queries.op12_fill_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 3


def test_texts_are_restored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = M.transform(docs, rate=100)
    assert found.where(F.col("form") == "plain").count() < 20
    both = found.select("doc_id", M.text_of(M.restored()).alias("t")).join(docs, "doc_id")
    assert both.where("t <> text").count() == 0
