"""The whole pipeline against a brute-force version in plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from conftest import SMALL
from test_groups import plain_fingerprint
from test_shared_words import plain_set

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, line_dedup, quality


def plain_quality(docs):
    def fails(text):
        measures = dict(zip(quality.MEASURES, quality.measure(text or "")))
        return any(eval(r.fails.replace(" AND ", " and ").replace(" OR ", " or ")
                        .replace(" = ", " == "), measures)
                   for r in quality.RULES if r.name in quality.LENIENT.rules)

    return [d for d in docs if not fails(d["text"])]


def plain_lines(docs):
    pages = {(d["source"], d["text"]) for d in docs}
    totals = Counter(host for host, _ in pages)
    distinct = {p: {x.strip(" \t\r") for x in p[1].split("\n")} - {""} for p in pages}
    counts = Counter((host, line) for (host, _), own in distinct.items() for line in own)
    frequent = {k for k, n in counts.items() if n >= line_dedup.MIN_PAGES
                and 100 * n > line_dedup.PERCENT * totals[k[0]]}

    def words(lines):
        return sum(len(re.split("[ \t\r]+", x)) for x in lines)

    drops, groups = {}, defaultdict(list)
    for page, own in distinct.items():
        gone = {x for x in own if (page[0], x) in frequent}
        if gone and 100 * words(gone) <= line_dedup.COPY_PERCENT * words(own):
            drops[page] = gone
            if 100 * words(gone) > line_dedup.WHOLE_PERCENT * words(own):
                groups[page[0], frozenset(gone)].append(page)
    out = []
    for d in docs:
        page = d["source"], d["text"]
        kept = [x for x in d["text"].split("\n") if x.strip(" \t\r") not in drops.get(page, ())]
        if page in drops and any(x.strip(" \t\r") for x in kept):
            d = d | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))}
        out.append(d | {"like": groups.get((page[0], frozenset(drops.get(page, ()))), [])})
    return out


def plain_near(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    seen = [(plain_fingerprint(d["text"]), plain_set(d["text"])) for d in docs]
    name = list(range(len(docs)))
    for i, (f, s) in enumerate(seen):
        for j, (g, t) in enumerate(seen[:i]):
            if (f ^ g).bit_count() <= 4 or s and t and 5 * len(s & t) >= 4 * len(s | t):
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    return [d for i, d in enumerate(docs) if name[i] == i]


def plain_leaks(docs, items):
    numbers = defaultdict(lambda: len(numbers))
    coded = [np.array([numbers[w] for w in decontaminate.words_of(t)]) for t in items]
    out = []
    for d in docs:
        text = np.array([numbers[w] for w in decontaminate.words_of(d["text"])])
        if not any(len(c) and decontaminate.fewest_edits(c, text) <= decontaminate.allowed(
                len(c), decontaminate.SIMILARITY) for c in coded):
            out.append(d)
    return out


def test_pipeline_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    cleaned = plain_lines(plain_quality(docs))
    # Which page of a group of like ones stays whole is the operator's choice; here there is no such.
    assert not any(d.pop("like") for d in cleaned)
    want = plain_leaks(plain_near(cleaned), items)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE)))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert sorted(got) == sorted(d["doc_id"] for d in want)
    for d in want:
        r = got[d["doc_id"]]
        ids = library.encode_ordinary(d["text"])
        assert {c: r[c] for c in d} == d
        assert np.frombuffer(r.ids, np.uint32).tolist() == ids and r.n_tokens == len(ids)
