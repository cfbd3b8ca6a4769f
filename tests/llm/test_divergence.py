"""Kept terms and divergences against a plain recount; odd rows; work that the levels leave out."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from aerospark.llm import divergence
from aerospark.llm.base import cut

SCHEMA = "text string, lang string, source string, kind int, item string, `p.q` string"


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def recount(rows, least, top):
    docs = [(lang or "", source or "", terms_of(text)) for text, lang, source in rows]
    held = collections.Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = collections.defaultdict(list)
    for (lang, t), n in held.items():
        if n >= least:
            kept[lang].append(t)
    counts, whole = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, terms in docs:
        counts[lang, source]  # a group without terms is one too
        for t in terms:
            if t in kept[lang]:
                counts[lang, source][t] += 1
                whole[lang][t] += 1

    def share(count, lang, t):
        return 1 + 10**9 * (count[t] + 1) // (sum(count.values()) + len(kept[lang]))

    out = set()
    for (lang, source), count in counts.items():
        pairs = []
        for (other_lang, other), theirs in counts.items():
            if other_lang == lang and other != source:
                value = 0
                for t in kept[lang]:
                    p, q = share(count, lang, t), share(theirs, lang, t)
                    value += (p - q) ** 2 // q
                pairs.append((-value, other.encode(), other))
        out |= {(lang, source, "pair", x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(pairs))}
        found = []
        for t in count:
            p, q = share(count, lang, t), share(whole[lang], lang, t)
            if p > q:
                found.append((-((p - q) ** 2 // q), t.encode(), t))
        out |= {(lang, source, "term", x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(found)[:top])}
    return out


ROWS = [
    ("alpha Beta gamma alphabet alphabets", "en", "a"), ("ALPHA beta beta alphabet", "en", "a"),
    ("alpha beta alphabet " + "gamma " * 500, "en", "b"), ("alphabets alphabets", "en", "b"),
    ("alphabets ab abc abcd abcde", "en", None), ("ab abc abcd abcde é éé ÉÉ", "en", "c"), ("ab abcd abcde éé", "en", "c"),
    (None, "en", "silent"), ("", "en", "silent"), ("123 !! \n\t", "en", "digits"), (None, None, None),
    ("alone words here", "xx", "one"), ("alone words", "xx", "two"), ("東京 東京タワー 東京", None, "jp"),
    ("東京 é", None, "jp"), ("東京タワー 東京 é", None, "q"), ("東京タワー", None, ""), ("z" * 20_000, "en", "a"),
    ("z" * 20_000 + " " + "z" * 19_999, "en", "b"), ("z" * 20_000, "en", "b"), ("z" * 20_001, "en", "long"),
    ("same row", "en", "d"), ("same row", "en", "d"), ("same row", "en", "d"), ("a\x00b[c]d{e}f~g@h`i", "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in ROWS], SCHEMA)


@pytest.mark.parametrize("least, top", [(3, 200), (2, 3), (1, 200), (5, 200)])
def test_against_a_recount(docs, least, top):
    found = divergence.divergence(docs.repartition(3), least=least, top=top).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found)
    assert got == recount(ROWS, least, top)


def test_short_runs_count_documents_once():
    """Runs of documents that end anywhere give the same sums."""
    held = None
    for size in (1, 2, 3, len(ROWS)):
        documents, occurrences = collections.Counter(), collections.Counter()
        for at in range(0, len(ROWS), size):
            run = divergence.Run()
            for text, lang, source in ROWS[at: at + size]:
                run.add(lang or "", source or "", [t.encode() for t in terms_of(text)])
            for part in run.counts():
                for row in part.to_pylist():
                    assert row["open"] == (row["by_source"] is None)
                    half = (divergence.FIRST << row["level"]) // 2 if row["level"] else 0
                    assert row["parent"] == row["item"][:half]
                    documents[row["open"], row["level"], row["lang"], row["item"]] += row["n"]
                    for own in row["by_source"] or []:
                        occurrences[row["lang"], own["source"], row["item"]] += own["n"]
        held = held or (documents, occurrences)
        assert (documents, occurrences) == held
    heads, counts = collections.Counter(), collections.Counter()
    for text, lang, source in ROWS:
        counts.update((lang or "", source or "", t.encode()) for t in terms_of(text))
        own = set()
        for t in {t.encode() for t in terms_of(text)}:
            level = 0
            while len(t) > divergence.FIRST << level:
                own.add((True, level, lang or "", t[: divergence.FIRST << level]))
                level += 1
            own.add((False, level, lang or "", t))
        heads.update(own)
    assert held == (heads, counts)


def test_full_runs_are_given_out(monkeypatch):
    run = divergence.Run()
    run.add("en", "a", [b"x"] * 3)
    assert not run.full()
    monkeypatch.setattr(divergence, "RUN", 2)
    assert run.full()


def test_rare_prefixes_are_not_followed(spark, docs):
    partials = cut(divergence.partial_counts(docs, text="text", lang="lang", source="source"))
    deepest = partials.agg(F.max("level")).first()[0]
    assert deepest > 10
    kept = {(r["lang"], bytes(r["term"]).decode()) for r in divergence.kept_terms(partials, 3).collect()}
    held = collections.Counter((lang or "", t) for text, lang, _ in ROWS for t in set(terms_of(text)))
    assert kept == {k for k, n in held.items() if n >= 3}
    assert divergence.kept_terms(partials, 1000).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.divergence(empty).count() == 0
