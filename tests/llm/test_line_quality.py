from collections import Counter, defaultdict

import corpus_pipeline
from conftest import words

from rollbook.llm.line_quality import quality

LOWER = {i: i + 32 for i in range(65, 91)} | {i: 48 for i in range(48, 58)}


def counted(rows, copies):
    """Documents of each host, and of each host with each line; without copies those with one text are one."""
    lines, hosts = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(words(line.translate(LOWER)))
    for n, r in enumerate(rows):
        name = n if copies else r.text or ""
        hosts[r.source].add(name)
        for line in (r.text or "").split("\n"):
            lines[r.source, norm(line)].add(name)
    return lines, hosts, norm


def brute(rows, limit=20, percent=2, most=5000, copies=True):
    """Straight from the rules, one document at a time."""
    lines, hosts, norm = counted(rows, copies)
    out = Counter()
    for r in rows:
        text = r.text or ""
        w = words(text)
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup, taken = set(), 0, 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
                n = len(lines[r.source, norm(line)])
                taken += len(words(line)) if n > limit and (n * 100 > len(hosts[r.source]) * percent or n > most) else 0
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        left = len(w) - taken
        out[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), taken, failed, not failed and 100 * left >= 30 * len(w))] += 1
    return out


def test_against_brute_force(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        assert Counter(map(tuple, quality(docs).collect())) == brute(docs.collect())
        assert Counter(map(tuple, quality(docs, copies=False, line_most=30, line_percent=50).collect())) == brute(docs.collect(), percent=50, most=30, copies=False)
    got = {r.doc_id: r for r in quality(odd_docs).collect()}
    assert got[10].frequent_words == 10 and got[10].kept
    assert quality(no_docs).collect() == []


def test_depleted_documents_are_rejected(spark):
    rows = [(i, f"only {'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP'[i]}\n" + "a shared line of the whole host that is long enough to pass twenty words in all and more than that too", "h") for i in range(42)]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(not r.base_failed and not r.kept for r in got)


def brute_texts(rows, limit=20, percent=2, copies=True):
    """Each text joined from its lines that are not frequent in its host."""
    lines, hosts, norm = counted(rows, copies)
    often = {(h, x) for (h, x), of in lines.items() if x and len(of) > limit and len(of) * 100 > len(hosts[h]) * percent}
    return [(r, None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, norm(x)) not in often)) for r in rows]


def test_frequent_lines_are_taken_out_of_texts(spark, sf, odd_docs, no_docs):
    foot = "seite 3 von 9 dieses hauses"
    edges = [f"{foot}\n{{}} ü one", f"{{}} two\n\n{foot.upper()}", f"{{}} three\n{foot}\n  {foot} \nlast", f"{foot}\n{foot}", f"{{}} four\n", "\n\n", f"\n{{}} five\n{foot}\n\n", f"{foot}\n\n{foot}"]
    hosts = spark.createDataFrame([(i, edges[i % 8].format(f"w{i}"), "en", h, i) for h in ("p", "q", None) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    changed = 0
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs, hosts):
        got = quality(docs, cleaned=True, keep=["lang", "source"])
        want = brute_texts(docs.collect())
        changed += sum(r.text != text for r, text in want)
        assert Counter((r.doc_id, r.lang, r.source, r.text) for r in got.collect()) == Counter((r.doc_id, r.lang, r.source, text) for r, text in want)
        assert Counter(map(tuple, got.drop("text", "lang", "source").collect())) == brute(docs.collect())
    assert changed > 300
    assert quality(no_docs, cleaned=True, keep=["lang"]).collect() == []


def test_pipeline_passes_cleaned_texts_on(spark, odd_docs):
    docs = odd_docs.select(corpus_pipeline.COLUMNS)
    kept = {r.doc_id for r in quality(docs, copies=False).where("kept").collect()}
    want = Counter((r.doc_id, text, r.lang, r.source, len(text)) for r, text in brute_texts(docs.collect(), copies=False) if r.doc_id in kept)
    got = Counter(map(tuple, corpus_pipeline.quality_rules(spark, docs, None).collect()))
    assert got == want and not any("footer" in text for _, text, *_ in got)
