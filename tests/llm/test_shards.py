import random
import zlib

from tabwright.llm.shards import best_fit_decreasing, shard


def one_by_one(runs, capacity, bins):
    room, out = [capacity] * (bins or 0), []
    for size, count in sorted(runs, reverse=True):
        for _ in range(count):
            fit = [(r, k) for k, r in enumerate(room) if r >= size]
            if fit:
                k = min(fit)[1]
            elif bins:
                k = max((r, -i) for i, r in enumerate(room))[1] * -1
            else:
                room.append(max(capacity, size))
                k = len(room) - 1
            room[k] -= size
            out.append((size, k))
    return out, room


def test_runs_pack_like_single_groups():
    rng = random.Random(8)
    for _ in range(60):
        runs = [(s, rng.randint(1, 9)) for s in rng.sample(range(1, 60), rng.randint(1, 12))]
        for bins in (None, 4):
            capacity = -(-sum(s * n for s, n in runs) // 4) if bins else 70
            placed = best_fit_decreasing(runs, capacity, bins)
            loads = {}
            for size, a, b, k in placed:
                loads[k] = loads.get(k, 0) + size * (b - a)
            slow, room = one_by_one(runs, capacity, bins)
            assert sum(b - a for _, a, b, _ in placed) == len(slow)
            assert sorted(loads.values()) == sorted(x for x in ([max(capacity, 0) - r for r in room]) if x)


def check(rows, source, bins=8):
    texts = sorted(((r["doc_id"], r["text"]) for r in source), key=repr)
    assert len(rows) == len(texts)
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    for k in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    shards = {}
    for r in rows:
        shards.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_near_equal_shards_of_whole_groups(prose, messy, empty):
    rows = shard(prose).collect()
    check(rows, prose.collect())
    loads = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(8)]
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    check(shard(messy).collect(), messy.collect())
    assert shard(empty).count() == 0
    fixed = shard(prose, shards=None, capacity=20_000).collect()
    check(fixed, prose.collect())
    assert len({r["shard"] for r in fixed}) <= -(-sum(r["size"] for r in fixed) // 20_000) + 1
