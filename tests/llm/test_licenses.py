import re

from tabwright.llm.licenses import TEMPLATES, license_matches, template_bigrams

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, t=0.8):
    out = []
    for doc, text in rows:
        if text is None:
            continue
        low = "".join(c.lower() if c.isascii() else c for c in text)
        for k, p in enumerate([low, *(low.split("\n") if "\n" in low else [])]):
            words = WORD.findall(p)
            a = {f"{x} {y}" for x, y in zip(words, words[1:], strict=False)}
            for name, template in TEMPLATES.items():
                b = set(template_bigrams(template))
                if a and 2 * len(a & b) / (len(a) + len(b)) >= t:
                    out.append((doc, k, name, len(a), len(b), len(a & b), 2 * len(a & b) / (len(a) + len(b))))
    return sorted(out, key=repr)


def test_against_all_templates(llm, messy, prose, empty):
    own = [(k, f"intro\n{t}\nmore text of any kind" if k % 2 else t.upper()) for k, t in enumerate(TEMPLATES.values())]
    own += [(90, "Released under the MIT License and nothing else at all"), (91, "released   under THE mit-license!"), (92, "the MIT"), (93, "License")]
    for df in (llm.createDataFrame(own, "doc_id long, text string"), messy, prose, empty):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = license_matches(df)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    assert len(brute(own)) > len(TEMPLATES)


def test_only_projections_and_filters(prose):
    plan = license_matches(prose.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join|Aggregate", plan)
