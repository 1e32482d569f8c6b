"""Phrase collocations by Toivonen's sampling: a sample proposes, one full pass counts, a closing pass completes.

1. A sample of the documents is mined with a lowered threshold, words and pairs first, then longer phrases all of
   whose pairs were frequent. What is frequent there is the proposal.
2. A full pass counts exactly, in all documents, every phrase whose two parts (without its last, without its first
   word) are proposed: that is the proposal and its negative border. All single words are counted.
3. A frequent phrase of the border is a failure: longer phrases around it were never counted. A further pass counts
   every phrase not counted before whose parts are frequent or, for the same reason, not counted yet; after
   it no phrase with frequent parts is uncounted, so one such pass closes the search.
4. Nearly all frequent phrases occur in the sample, so it spells them first; the closing pass spells those that are left, else
   each of its tasks would spell all it meets. It runs for that alone where nothing failed.

Phrases travel as 96-bit hashes of their language and words, counted inside each task before they are shuffled, and
membership tests use bit sets (grains.Bits), whose foreign hits only count a phrase more. So neither a
frequent word nor a frequent phrase meets in one task, and nothing but bit sets of bounded size reaches the driver.
Scores, cuts and containment are joins over the frequent phrases; products are decimals.

Defined results: a null or empty text has no words; a null lang is `und` and one group with a literal `und`; repeated
rows count each. Other columns are not read. An empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import mix64, stored
from tabwright.llm.grains import Bits, Words, chunks, gram_hashes
from tabwright.llm.registry import register, table

LEAST = 30
LONGEST = 4
SAMPLE = 8  # one document of so many proposes
TOP = 2000
HELD = 1 << 20  # hashes a task holds before it counts them
OUT_ROWS = 1 << 16
TOLD = 1 << 21  # frequent phrases of a length that a task remembers to have spelt; more are spelt again

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[*b".,;:!?", *range(10, 14)]] = True
IS_WORD = ~IS_BREAK
IS_WORD[[32, 9]] = False

COUNTS = "n byte, h long, g int, c long"


class Grams:
    """Phrases of a chunk: for each length, which places start one, and the hashes there."""

    def __init__(self, words: Words, languages: np.ndarray):
        self.words = words
        self.languages = languages[words.row] if len(words.row) else np.zeros(0, dtype=np.uint64)

    def whole(self, n: int) -> np.ndarray:
        """Places where n words of one piece start."""
        piece = self.words.piece
        out = np.zeros(len(piece), dtype=bool)
        if len(piece) >= n:
            out[: len(piece) - n + 1] = piece[: len(piece) - n + 1] == piece[n - 1 :]
        return out

    def hashes(self, n: int) -> np.ndarray:
        out = np.zeros(len(self.words.hash), dtype=np.uint64)
        found = gram_hashes(self.words.hash, n)
        out[: len(found)] = found
        return mix64(out ^ self.languages)

    def second(self, n: int) -> np.ndarray:
        out = np.zeros(len(self.words.hash), dtype=np.uint64)
        found = gram_hashes(self.words.hash, n, second=True)
        out[: len(found)] = found
        return (mix64(out + self.languages) >> np.uint64(32)).astype(np.uint32)


def both(at: np.ndarray) -> np.ndarray:
    """Places where it holds here and at the next place."""
    out = np.zeros(len(at), dtype=bool)
    out[:-1] = at[:-1] & at[1:]
    return out


def distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first place of each distinct hash, its count, hashes in order, their seconds, the order)."""
    order = np.argsort(h)
    h, g = h[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
    return first, np.diff(np.append(first, len(h))), h, g, order


class Tally:
    """Counts of 96-bit hashes, given out once many are held."""

    def __init__(self):
        self.held: dict[int, list] = {}
        self.size = 0

    def add(self, n: int, h: np.ndarray, g: np.ndarray) -> None:
        if len(h):
            self.held.setdefault(n, []).append((h, g))
            self.size += len(h)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for n, parts in self.held.items():
            h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            first, counts, h, g, _ = distinct(h, g)
            yield from count_rows(n, h[first], g[first], counts)
        self.held, self.size = {}, 0


def count_rows(n: int, h: np.ndarray, g: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(h), OUT_ROWS):
        part = slice(at, at + OUT_ROWS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(h[part]), n, dtype=np.int8)),
                pa.array(h[part].view(np.int64)),
                pa.array(g[part].view(np.int32)),
                pa.array(counts[part].astype(np.int64)),
            ],
            names=["n", "h", "g", "c"],
        )


def _count(choose, totals: bool = False):
    """Counts of the phrases that choose(grams) names: {n: (places, their hashes)}; with words per language as n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, words_of = Tally(), {}
        for batch in batches:
            languages = batch.column(0).to_numpy().view(np.uint64)
            for words in chunks(batch.column(1).to_pylist(), IS_WORD, IS_BREAK):
                grams = Grams(words, languages)
                for n, (places, hashes) in choose(grams).items():
                    at = np.flatnonzero(places)
                    tally.add(n, hashes[at], grams.second(n)[at])
                if totals:
                    for lang, n in zip(*np.unique(grams.languages, return_counts=True), strict=True):
                        words_of[lang] = words_of.get(lang, 0) + int(n)
                if tally.size > HELD:
                    yield from tally.rows()
        yield from tally.rows()
        if words_of:
            yield from count_rows(0, np.array(list(words_of), dtype=np.uint64), np.zeros(len(words_of), dtype=np.uint32), np.array(list(words_of.values())))

    return run


def words_and_pairs(grams: Grams) -> dict:
    return {1: (grams.whole(1), grams.hashes(1)), 2: (grams.whole(2), grams.hashes(2))}


def longer(pairs: Bits, longest: int):
    """Phrases of three words and more all of whose pairs are in the set."""

    def choose(grams: Grams) -> dict:
        held, out = grams.whole(2) & pairs.has(grams.hashes(2)), {}
        for n in range(3, longest + 1):
            held = both(held)
            out[n] = (held & grams.whole(n), grams.hashes(n))
        return out

    return choose


def proposed(sets: dict[int, Bits], longest: int):
    """The proposal and its border: phrases whose two parts are proposed; all words."""

    def choose(grams: Grams) -> dict:
        places, out = grams.whole(1), {}
        for n in range(1, longest + 1):
            hashes = grams.hashes(n)
            out[n] = (places, hashes)
            if n < longest:
                places = both(places & sets[n].has(hashes)) & grams.whole(n + 1)
        return out

    return choose


def uncounted(sets: dict[int, Bits], frequent: dict[int, Bits], longest: int, unspelt: dict[int, Bits] | None = None):
    """(phrases not counted before whose parts are frequent or not counted before, frequent ones that were counted, of these only
    the unspelt ones where such are given)."""
    before = proposed(sets, longest)

    def choose(grams: Grams) -> tuple[dict, dict]:
        new, old = {}, {}
        possible = None
        for n, (counted, hashes) in before(grams).items():
            old[n] = (counted & frequent[n].has(hashes), hashes)
            fresh = both(possible) & grams.whole(n) & ~counted if n > 1 else np.zeros(len(counted), dtype=bool)
            new[n] = (fresh, hashes)
            possible = old[n][0] | fresh
            if unspelt is not None:
                old[n] = (old[n][0] & unspelt[n].has(hashes), hashes)
        return new, old

    return choose


SPELT = "n byte, h long, g int, c long, lang string, phrase string"


def spell(words: Words, at: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
    """(order, phrases): the n words from each place, joined by one space, and which of the places each phrase is of."""
    first, last = words.starts[at], words.ends[at + n - 1]
    letters = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    tight = last - first == letters[at + n] - letters[at] + n - 1  # single separators: the phrase is one stretch of bytes
    some, rest = np.flatnonzero(tight), np.flatnonzero(~tight)
    sizes = (last - first)[some]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    data = words.low[np.arange(ends[-1]) + np.repeat(first[some] - ends[:-1], sizes)]
    data[data == 9] = 32
    found = pa.StringArray.from_buffers(len(some), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    loose = pa.array([words.phrase(k, n).decode() for k in at[rest].tolist()], type=pa.string())
    return np.concatenate((some, rest)), pa.concat_arrays([found, loose])


def _spelt(n: int, h: np.ndarray, g: np.ndarray, c: np.ndarray, lang: pa.Array, phrase: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(h), n, dtype=np.int8)), pa.array(h.view(np.int64)), pa.array(g.view(np.int32)), pa.array(c.astype(np.int64)), lang, phrase]
    return pa.RecordBatch.from_arrays(columns, names=["n", "h", "g", "c", "lang", "phrase"])


def _fresh(h: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Places of hashes (in order) that are not told yet."""
    if not len(told):
        return np.arange(len(h))
    at = np.minimum(np.searchsorted(told, h), len(told) - 1)
    return np.flatnonzero(told[at] != h)


def _close(choose, expand: bool):
    """Rows of counts of new phrases, each with its words, and, once a task, the words of the frequent phrases (c = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, np.ndarray] = {}
        none = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            languages, names = batch.column(0).to_numpy().view(np.uint64), batch.column(2).cast(pa.string())
            l, first = np.unique(languages, return_index=True)
            new_l = _fresh(l, told.get(0, none))
            told[0] = np.union1d(told.get(0, none), l)
            yield _spelt(0, l[new_l], np.zeros(len(new_l), dtype=np.uint32), np.zeros(len(new_l)), names.take(pa.array(first[new_l])), pa.array([""] * len(new_l), type=pa.string()))
            for words in chunks(batch.column(1).to_pylist(), IS_WORD, IS_BREAK):
                grams = Grams(words, languages)
                new, old = choose(grams)
                for known, found in ((True, old), (False, new if expand else {})):
                    for n, (places, hashes) in found.items():
                        at = np.flatnonzero(places)
                        if not len(at):
                            continue
                        first, counts, h, g, order = distinct(hashes[at], grams.second(n)[at])
                        h, g, at = h[first], g[first], at[order[first]]
                        if known:
                            some = _fresh(h, told.get(n, none))
                            h, g, at, counts = h[some], g[some], at[some], np.zeros(len(some))
                            held = told.get(n, none)
                            told[n] = np.union1d(held if len(held) < TOLD else none, h)
                        if len(h):
                            own, phrases = spell(words, at, n)
                            yield _spelt(n, h[own], g[own], counts[own], names.take(pa.array(words.row[at[own]])), phrases)

    return run


def _packed(rows: DataFrame) -> DataFrame:
    """The rows with n and g in one number `k`, which makes a shuffled row shorter by a field."""
    return rows.withColumn("k", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("g").cast("long").bitwiseAND(F.lit((1 << 32) - 1)))).drop("n", "g")


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"n": F.shiftright("k", 32).cast("byte"), "g": F.shiftright(F.shiftleft("k", 32), 32).cast("int")}).drop("k")


def _once(rows: DataFrame) -> DataFrame:
    """A row for each phrase, with its words and the sum of its counts."""
    spelt = _packed(rows).groupBy("h", "k").agg(F.sum("c").alias("c"), F.max("lang").alias("lang"), F.max("phrase").alias("phrase"))
    return _unpacked(spelt).select("n", "h", "g", "c", "lang", "phrase")


def _summed(rows: DataFrame, least: int, name: str) -> DataFrame:
    counts = _unpacked(_packed(rows).groupBy("h", "k").agg(F.sum("c").alias("c")))
    return stored(counts.select("n", "h", "g", "c").where((F.col("c") >= least) | (F.col("n") == 0)), name)


def _sets(counts: DataFrame, lengths) -> dict[int, Bits]:
    return {n: Bits(counts.where(F.col("n") == n).select("h")) for n in lengths}


def frequent_phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, n, phrase, f) of all phrases of up to `longest` words that occur `least` times; n = 0 has all words of a lang."""
    if longest < 2:
        raise ValueError("phrases have two words at least")
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    slim = documents.select(F.xxhash64(name).alias("l"), F.coalesce(F.col(text), F.lit("")).alias("text"), name.alias("lang"))
    named = slim.where(F.crc32(F.col("text").cast("binary")) % sample == 0)
    some = named.select("l", "text")
    lowered = min(least, max(2, least // (2 * sample)))
    drawn = _summed(some.mapInArrow(_count(words_and_pairs), COUNTS), lowered, "phrases-sample")
    proposal = _sets(drawn, (1, 2))
    if longest > 2:
        more = _summed(some.mapInArrow(_count(longer(proposal[2], longest)), COUNTS), lowered, "phrases-sample")
        proposal |= _sets(more, range(3, longest))
        drawn = drawn.unionAll(more)

    counted = _summed(slim.select("l", "text").mapInArrow(_count(proposed(proposal, longest), totals=True), COUNTS), least, "phrases-counts")
    frequent = _sets(counted, range(1, longest + 1))
    failures = counted.where((F.col("n") > 0) & (F.col("n") < longest)).join(drawn.select("n", "h", "g"), ["n", "h", "g"], "left_anti")
    expand = not failures.isEmpty()
    first = stored(_once(named.mapInArrow(_close(uncounted(proposal, frequent, longest), False), SPELT)), "phrases-spelt")
    rest = stored(counted.where("n > 0").join(first.select("n", "h", "g"), ["n", "h", "g"], "left_anti"), "phrases-unspelt")
    unspelt = _sets(rest, range(1, longest + 1))
    closing = slim.mapInArrow(_close(uncounted(proposal, frequent, longest, unspelt), expand), SPELT)
    spelt = _once(closing.unionAll(first)).withColumnRenamed("c", "_c")
    both_ = spelt.join(counted, ["n", "h", "g"], "left")
    found = both_.select("lang", F.col("n").cast("int").alias("n"), "phrase", F.coalesce("c", "_c").alias("f"))
    return stored(found.where((F.col("f") >= least) | (F.col("n") == 0)), "phrases-frequent")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = 80, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each lang's `top` collocations.

    The score is floor(2000000 a / (l + r)) of the worst cut in two; a phrase inside a longer one that has
    `inside` percent of its occurrences is left out.
    """
    found = frequent_phrases(documents, least, longest, **options)
    phrases = found.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.col("n").alias("size"))
    part = lambda word, count: F.array_join(F.slice("w", word, count), " ")

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"))
    known = found.where("n >= 1").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "f")
    for side, out in (("_left", "l"), ("_right", "r")):
        own = known.withColumnRenamed("f", out)
        cuts = cuts.join(own, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).drop("_lang", "_phrase", side)
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # the most frequent longer candidate that each phrase lies in
    within = phrases.where("size > 2").withColumn("count", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    within = within.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("count") + 1)))
    within = within.select(F.col("lang").alias("_lang"), part(F.col("at"), F.col("count")).alias("_phrase"), "a")
    within = within.groupBy("_lang", "_phrase").agg(F.max("a").alias("longer"))
    own = scored.join(within, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    own = own.where(F.col("longer").isNull() | (F.expr("cast(100 as decimal(3, 0)) * cast(longer as decimal(19, 0))") < F.expr(f"cast({inside} as decimal(3, 0)) * cast(a as decimal(19, 0))")))
    totals = found.where("n = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = own.select("lang", "phrase", "a", "cut").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("_lang")).select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score")
    )


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
      FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, 5) AS s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS v FROM f WHERE size >= 2),
cuts AS (SELECT lang, phrase, a, k, array_to_string(v[1 : k], ' ') AS x, array_to_string(v[k + 1 :], ' ') AS y
         FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r,
                  CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score
           FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f AS y ON y.lang = cuts.lang AND y.phrase = cuts.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, array_to_string(v[i : i + n - 1], ' ') AS phrase, a
          FROM (SELECT lang, v, size, a, n, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM c))),
longer AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@register("op12_collocations", SQL)
def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
