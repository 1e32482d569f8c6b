import hashlib
from collections import Counter

import pytest

from tabwright.llm.repeats import repeated_spans, without_repeats


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[k : k + length] for _, x in data for k in range(len(x) - length + 1))
    out = []
    for d, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        runs = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in without_repeats(df, **options).collect()), key=repr
    )


@pytest.mark.parametrize("length,chunk,hot", [(400, 128, 256), (60, 24, 256), (60, 24, 2)])
def test_against_every_window(prose, length, chunk, hot):
    wanted = brute([(r["doc_id"], r["text"]) for r in prose.collect()], length)
    assert any(0 < r[2] < r[1] for r in wanted)
    assert found(prose, length=length, chunk=chunk, hot=hot) == wanted


def test_repeats_inside_one_text_and_periods(llm):
    a = "".join(chr(97 + k * k % 23) for k in range(200))
    rows = [(1, "start " + a + " middle " + a + " end"), (2, "ab" * 300), (3, "c" * 70), (4, "x" + a[:99] + "y"), (5, "é漢" * 60)]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    for hot in (256, 1):
        assert found(df, length=60, chunk=24, hot=hot) == brute(rows, 60)


def test_odd_rows(messy, empty):
    assert found(messy) == brute([(r["doc_id"], r["text"]) for r in messy.collect()], 400)
    assert found(empty) == []
    assert all(x.count() == 0 for x in repeated_spans(empty.select("text")))
