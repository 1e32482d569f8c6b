import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tabwright.llm.packing import best_fit, pack_runs, place
from tabwright.llm.tokens import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def test_rounds_fill_sequences_tightly():
    rng = random.Random(6)
    for _ in range(25):
        counts = Counter(min(64, int(rng.expovariate(0.06)) + 1) for _ in range(rng.randint(1, 3000)))
        plan = pack_runs(dict(counts), 64)
        spans = {}
        for n, a, b, first, offset in plan:
            for k in range(b - a):
                spans.setdefault(first + k, []).append((offset, n))
        for own in spans.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 64
        for n, c in counts.items():
            ranks = sorted((a, b) for m, a, b, _, _ in plan if m == n)
            assert ranks[0][0] == 0 and ranks[-1][1] == c and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:], strict=False))
        room, decreasing = [], sorted(counts.elements(), reverse=True)
        for n in decreasing:  # best fit decreasing, one by one
            fit = [r for r in room if r >= n]
            if fit:
                room[room.index(min(fit))] -= n
            else:
                room.append(64 - n)
        assert len(spans) <= len(room) * 1.02 + 1


def verify(df, sequence):
    rows = best_fit(df, PATH, sequence=sequence).collect()
    tokenizer = Tokenizer.from_file(PATH)
    wanted = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), sequence)):
            own = ids[at : at + sequence]
            wanted[r["doc_id"], k, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] >= 0 and r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= sequence for n in at.values())
    return len(at), sum(at.values())


def test_every_piece_has_its_place(prose, messy, empty):
    used, tokens = verify(prose, 512)
    assert used <= 1.03 * tokens / 512 + 1
    verify(messy, 2048)
    assert best_fit(empty, PATH).count() == 0


def test_lengths_and_checksums_follow_the_plain_call(llm):
    texts = ["end of sample <|endoftext|> next", "<|startoftext|>", "no mark", None]
    verify(llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8)


def test_matches_may_be_sent_in_parts(llm):
    counts = {k: 40 - k for k in range(1, 30)}
    ranked = llm.createDataFrame([(n, r) for n, c in counts.items() for r in range(c)], "length long, _rank long")
    plan = pack_runs(counts, 64)
    whole, parts = (sorted(tuple(r) for r in place(ranked, plan, 64, part).collect()) for part in (10**6, 7))
    assert whole == parts and min(r[2] for r in whole) == 0
