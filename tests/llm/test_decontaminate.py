import hashlib
import re

from tabwright.llm.decontaminate import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, items, n=10):
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        hit, names = set(), []
        for i, t in items:
            x = WORD.findall((t or "").translate(FOLD))
            k = min(n, len(x))
            own = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} if x else set()
            at = [a for a in range(len(w) - k + 1) if tuple(w[a : a + k]) in own] if x else []
            hit |= {a + j for a in at for j in range(k)}
            names += [i] if at else []
        listed = ",".join(sorted(str(i) for i in names if i is not None))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench(llm, prose):
    texts = [r["text"] for r in prose.orderBy("doc_id").limit(40).collect()]
    rows = [(k, " ".join(t.split()[3 : 3 + 6 * k])) for k, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, "... !!"), (None, "alpha BETA, gamma"), (10, "second line here"), (9, "second line here"), (9, "second line here")]
    return rows, llm.createDataFrame(rows, "item_id long, text string")


def found(docs, items, **options):
    columns = "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    return sorted((tuple(r) for r in contamination(docs, items, **options).select(*columns).collect()), key=repr)


def test_against_every_window(llm, prose, messy, empty):
    rows, items = bench(llm, prose)
    for df in (prose, messy):
        wanted = brute([(r["doc_id"], r["text"]) for r in df.collect()], rows)
        assert any(r[-1] for r in wanted)
        assert found(df, items) == wanted
        assert found(df, items, part_bytes=300) == wanted  # many passes over the documents
    assert found(empty, items) == []
    assert not any(r[-1] for r in found(messy, items.where("false")))


def test_documents_or_spans_go(llm, prose, messy):
    _, items = bench(llm, prose)
    clean = {r[0] for r in found(prose, items) if not r[-1]}
    assert {r["doc_id"] for r in decontaminate(prose, items).collect()} == clean
    cut = decontaminate(messy, items, remove="spans")
    assert cut.columns == messy.columns and cut.count() == messy.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == " delta epsilon zeta eta theta iota kappa lambda\n" and texts[3] is None and texts[4] == ""
