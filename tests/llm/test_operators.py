"""Operators against brute force on small rows with all the odd cases."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from folio.llm.decontamination import Decontaminator
from folio.llm.license_scan import PHRASES, LicenseScan
from folio.llm.lm_score import LmScore
from folio.llm.ngram_jaccard import NgramJaccard
from folio.llm.quality_rules import QualityRules
from folio.llm.sharding import Sharding
from folio.llm.substring_dedup import SubstringDedup
from folio.llm.token_counts import TokenCounts, vocabulary

from .cases import COLUMNS, as_rows, documents, lower

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def components(rows, percent=80, k=5):
    sets = []
    for _, text in rows:
        w = SPACED.findall(lower(text))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def test_ngram_jaccard(docs, rows, empty):
    assert as_rows(NgramJaccard().components(docs)) == ordered(components(rows))
    assert NgramJaccard().components(empty).count() == 0
    kept = NgramJaccard().one_of_each(docs)
    assert kept.columns == docs.columns
    want = {doc for doc, _, c in components(rows) if doc == c}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("options", [{"heavy_from": 2}, {"short": 2, "heavy_slots": 0}, {"short": 2, "refinements": 0}, {"percent": 60, "k": 2}, {"percent": 60, "k": 2, "short": 2, "broadcast_rows": 0}])
def test_ngram_jaccard_at_other_parameters(docs, rows, options):
    want = components(rows, options.get("percent", 80), options.get("k", 5))
    assert as_rows(NgramJaccard(**options).components(docs)) == ordered(want)


@pytest.mark.parametrize("options", [{}, {"heavy_slots": 0}, {"percent": 60, "k": 2}])
def test_ngram_jaccard_gives_all_links(docs, rows, empty, options):
    percent, k = options.get("percent", 80), options.get("k", 5)
    sets = set()
    for _, text in rows:
        w = SPACED.findall(lower(text))
        if w:
            sets.add(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))))
    by_id = {doc: text for doc, text in rows if doc is not None}
    own = NgramJaccard(**options)
    members = own.members(docs).collect()
    assert sorted(str(r.doc_id) for r in members) == sorted(str(doc) for doc, _ in rows)
    of = {}
    for r in members:
        if r.doc_id is not None and r.cid is not None:
            w = SPACED.findall(lower(by_id[r.doc_id]))
            of.setdefault(r.cid, set()).add(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))))
    assert all(len(x) == 1 for x in of.values())
    of = {c: next(iter(x)) for c, x in of.items()}
    found = [(r.a, r.b) for r in own.links(docs).collect()]
    assert all(a < b for a, b in found) and len(set(found)) == len(found)
    want = {frozenset((x, y)) for x, y in combinations(sets, 2) if 100 * len(x & y) >= percent * len(x | y)}
    assert {frozenset((of[a], of[b])) for a, b in found} == want and len(found) == len(want) > 0
    assert own.links(empty).count() == 0


def test_chains_of_near_copies(spark):
    """Each text is similar to the next ones only, so one component needs many links."""
    w = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(w[6 * i : 6 * i + 100])) for i in range(40)]
    got = NgramJaccard(short=2).components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(got) == ordered(components(rows))


@pytest.mark.parametrize("options", [{}, {"short": 4}, {"short": 4, "refinements": 0, "heavy_slots": 0}])
def test_a_large_group_of_near_copies(spark, options):
    """Copies of one text, of which about half are too far from it to link."""
    import random

    rng = random.Random(5)
    base = [f"v{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for j in rng.sample(range(120), rng.choice([1, 2, 3, 4, 5])):
            w[j] = rng.choice([f"x{i}", f"x{rng.randrange(3)}", ""])
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[10 * i : 10 * i + 40] + [f"y{i}"] * 5)) for i in range(8)]
    got = NgramJaccard(heavy_from=4, **options) if not options.get("refinements", 1) else NgramJaccard(**options)
    assert as_rows(got.components(spark.createDataFrame(rows, "doc_id long, text string"))) == ordered(components(rows))


def removed(rows, window=50):
    words = [SPACED.findall(t or "") for _, t in rows]
    least = {}
    for (doc, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and least[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), sha(" ".join(kept))))
    return out


@pytest.mark.parametrize("window", [50, 7, 2])
def test_substring_dedup(docs, rows, empty, window):
    assert as_rows(SubstringDedup(window).digests(docs)) == ordered(removed(rows, window))
    assert SubstringDedup(window).digests(empty).count() == 0


def test_substring_dedup_applied(docs, rows):
    out = SubstringDedup(20).apply(docs)
    assert out.columns == docs.columns
    got = ordered((r.doc_id, sha(" ".join(SPACED.findall(r.text or "")))) for r in out.collect())
    assert got == ordered((a, d) for a, _, _, d in removed(rows, 20))
    same = {a for a, _, n, _ in removed(rows, 20) if not n}
    texts = dict(rows)
    assert all(r.text == texts[r.doc_id] for r in out.collect() if r.doc_id in same)


def items(rows, spark):
    w = [ALNUM.findall(lower(t)) for _, t in rows]
    some = [" ".join(x[3:30]) for x in w if len(x) > 60][:6] + ["one two", "W1", None, "", "...", "never there at all"]
    listed = [(i, t) for i, t in enumerate(some)] + [(3, some[0]), (None, some[1]), (50, some[0])]
    return listed, spark.createDataFrame(listed, "item_id long, text string")


def hits(rows, listed, window=10):
    out = []
    for doc, text in rows:
        w, gone, found = ALNUM.findall(lower(text)), set(), set()
        for item, t in listed:
            x = ALNUM.findall(lower(t))
            m = min(window, len(x))
            keys = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in keys:
                    gone.update(range(i, i + m))
                    if item is not None:
                        found.add(str(item))
        out.append((doc, len(w), len(gone), len(found), sha(",".join(sorted(found))), bool(gone)))
    return out


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontamination(spark, docs, rows, empty, broadcast_rows):
    listed, table = items(rows, spark)
    own = Decontaminator(broadcast_rows=broadcast_rows)
    want = hits(rows, listed)
    assert as_rows(own.digests(docs, table)) == ordered(want)
    assert own.digests(empty, table).count() == 0
    assert not any(r.contaminated for r in own.digests(docs, table.limit(0)).collect())
    clean = own.clean(docs, table)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(x[0]) for x in want if not x[-1])


def test_quality_base(docs, rows, empty):
    got = as_rows(QualityRules().judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for doc, text in rows:
        w = SPACED.findall(text or "")
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c, covered = Counter(g), set()
        for i, x in enumerate(g):
            if c[x] > 1:
                covered.update((i, i + 1, i + 2))
        lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
        want.append((doc, len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == ordered(want)
    assert QualityRules().judge(empty).count() == 0 and QualityRules().keep(docs).columns == docs.columns


def test_quality_finds_junk_among_clean_texts(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    sentence = lambda: " ".join(word() for _ in range(9)) + "."
    clean = [(i, "\n".join(sentence() for _ in range(12))) for i in range(80)]
    junk = [(100 + i, " ".join(word() + "***%%" for _ in range(90))) for i in range(8)] + [(200 + i, " ".join(word().upper() + "!!" for _ in range(90))) for i in range(8)]
    got = {r.doc_id: r.kept for r in QualityRules().judge(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert {k for k, v in got.items() if v} == {i for i, _ in clean}


def test_sharding(docs, rows, empty):
    for shards in (40, 5, 1):
        got = Sharding(shards).assign(docs).collect()
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
        for s in {r.shard for r in got}:
            slots = sorted(r.slot for r in got if r.shard == s)
            assert 0 <= s < shards and slots == list(range(len(slots)))
        by_text = {}
        where = {(r.doc_id, r.text_crc32): r.shard for r in got}
        for d, t in rows:
            by_text.setdefault(t or "", set()).add(where[d, zlib.crc32((t or "").encode())])
        assert all(len(x) == 1 for x in by_text.values())
    assert Sharding(5).assign(empty).count() == 0


def test_capacity_is_minimal(spark):
    """Over the groups themselves, also where runs hold many of them."""
    import random

    rng = random.Random(3)
    for n, shards, bits, large in ((1, 3, 2, 9), (30, 4, 2, 9), (400, 7, 3, 50), (400, 5, 1, 3000), (60, 40, 4, 9), (500, 6, 0, 1)):
        sizes = sorted({rng.randrange(1 << 60): rng.randint(1, large) for _ in range(n)}.items())
        if n == 400:
            sizes += [(sizes[-1][0] + i, 5) for i in range(1, 4)]  # neighbours to the last bit
        values = [x for _, x in sizes]

        def needed(capacity):
            count, left = 1, capacity
            for x in values:
                count, left = (count, left - x) if x <= left else (count + 1, capacity - x)
            return count

        least = next(c for c in range(max(values), sum(values) + 1) if needed(c) <= shards)
        capacity, cuts = Sharding(shards, cell_bits=bits).cuts(spark.createDataFrame(sizes, "key long, size long"))
        assert capacity == least and cuts == sorted(cuts) and len(cuts) == shards - 1
        held = [0] * shards
        for key, x in sizes:
            held[sum(key >= c for c in cuts)] += x
        assert max(held) <= capacity
        if shards * max(values) < sum(values) / 4:
            assert min(held) > 0.6 * sum(values) / shards


def test_license_scan(spark, docs, rows, empty):
    got = as_rows(LicenseScan().digests(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    want = []
    for doc, text in rows:
        w, at, labels = ALNUM.findall(lower(text)), [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        want.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == ordered(want)
    assert LicenseScan().digests(empty).count() == 0


def test_license_templates_with_changes(spark):
    text = "Before. Permission is hereby granted free of charge to any other person obtaining a copy of this fine software and associated documentation files to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the Software. After"
    r = LicenseScan().digests(spark.createDataFrame([(1, text), (2, "Permission is hereby granted to go home")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].labels, r[0].base_labels, r[0].n_base) == ("mit", "", 0) and 0.6 <= r[0].score < 1
    assert (r[1].labels, r[1].score) == ("", 0.0)


def test_lm_score(docs, rows, empty):
    for order in (1, 2, 3):
        words = [SPACED.findall(lower(t)) for _, t in rows]
        grams = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in words]
        every = sum(grams, Counter())
        n = sum(map(len, words))
        want = []
        for (doc, _), w, own in zip(rows, words, grams):
            rest = lambda g: every[g] - own[g]  # noqa: E731, B023

            def s(context, x):
                if not context:
                    return max(rest((x,)), 0.5) / max(1, n - len(w))  # noqa: B023
                c = rest((*context, x))  # noqa: B023
                return c / max(1, rest(context)) if c > 0 else 0.4 * s(context[1:], x)  # noqa: B023

            want.append((doc, len(w), sum(np.log(s(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w))))
        got = as_rows(LmScore(order).scores(docs).select("doc_id", "n_words", "log_score"))
        want = ordered(want)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert LmScore().scores(empty).count() == 0


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = vocabulary()
    low = [(f"<0x{i:02X}>", -1e12) for i in range(256)]
    for scored in (pieces, [(p, -float(len(p) % 3)) for p, _ in pieces]):  # the second has ties everywhere
        unigram = Tokenizer(models.Unigram([("<unk>", 0.0), *scored], 0, False))
        unigram.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(__import__("tokenizers").Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always")])
        known = {p for p, _ in scored}
        got = ordered((r.doc_id, r.n_tokens) for r in TokenCounts(scored).counts(docs).collect())  # repeated rows too
        tokens = [(doc, unigram.encode(text or "", add_special_tokens=False).tokens) for doc, text in rows]
        assert got == ordered((doc, sum(1 if t in known else len(t.encode()) for t in found)) for doc, found in tokens)
    assert low and TokenCounts().counts(empty).count() == 0


@pytest.mark.parametrize("more", [[], [("a▁b", -1.0), ("\n▁", -2.0)]])
def test_token_counts_of_whole_texts(spark, docs, rows, more):
    """White space is counted too; the second vocabulary has pieces that lie across words."""
    from tokenizers import Tokenizer, models

    odd = ["a\nb", "a  b", " a ", "\n", "   ", "a\tb\r\n", "if x:\r\n        y();\r\n", "a▁b", "\n\n a", "\x0b\x0c\u00a0 \u2028", " " * 300 + "a" + "\n" * 50]
    texts = [(1000 + i, t) for i, t in enumerate(odd)] + [(i, t) for i, t in rows if i is not None]
    pieces = vocabulary() + more
    for scored in (pieces, [(p, -float(len(p) % 3)) for p, _ in pieces]):
        unigram = Tokenizer(models.Unigram([("<unk>", 0.0), *scored], 0, False))
        known = {p for p, _ in scored}
        got = {r.doc_id: (r.n_words, r.n_tokens) for r in TokenCounts(scored, whole=True).counts(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        for doc, text in texts:
            tokens = unigram.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).tokens if text else []
            assert got[doc] == (len(SPACED.findall(text or "")), sum(1 if t in known else len(t.encode()) for t in tokens)), (doc, text)


def test_the_registered_count_takes_white_space(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    from folio.llm.registry import QUERIES

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a b", "a\nb", "a  b", " a ", "a\n\n\tb", "   "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_tokens for r in QUERIES["op6_token_counts"](spark, str(tmp_path)).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_a_window_that_all_documents_have(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}", f"b{i}"] * (i % 5) + passage + [f"c{i}"] * (i % 3) + passage[: 50 + i % 7])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert as_rows(SubstringDedup().digests(docs)) == ordered(removed(rows))


def test_a_window_that_all_items_and_documents_have(spark):
    common = " ".join(f"q{i}" for i in range(12))
    listed = [(i, f"{common} own{i} words{i}") for i in range(150)] + [(150 + i, common) for i in range(3)]
    rows = [(i, f"x{i} y{i} {common}" + f" own{i} words{i}" * (i % 2)) for i in range(60)] + [(90, "nothing of it"), (91, common[:20])]
    table = spark.createDataFrame(listed, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(Decontaminator().digests(docs, table)) == ordered(hits(rows, listed))


def test_decontamination_of_a_very_long_text(spark):
    """300,000 words, with a passage of an item at the end."""
    words = [f"w{i * i % 7919}" for i in range(300_000)]
    item = [f"m{i}" for i in range(25)]
    docs = spark.createDataFrame([(1, " ".join(words + item[3:20]))], "doc_id long, text string")
    table = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    (row,) = Decontaminator().digests(docs, table).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (300_017, 17, 1, True)


def test_license_spans_of_changed_and_repeated_texts(spark):
    """A template with words changed, put in and left out is found; half of one isn't; two side by side are two."""
    from folio.llm.license_scan import TEMPLATES

    words = TEMPLATES[0][1].split()
    changed = words[:10] + ["another"] + words[10:25] + words[26:]
    texts = [" ".join(words), "x y " + " ".join(changed) + " z", " ".join(words[: len(words) // 3]), " ".join([*words, *words]), "no license at all"]
    found = LicenseScan().spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("label = 'mit' AND NOT phrase").collect()
    by_doc = Counter(r.doc_id for r in found)
    assert by_doc[0] == by_doc[1] == 1 and by_doc[3] == 2 and not by_doc[2] and not by_doc[4]
    n = len(ALNUM.findall(lower(texts[0])))
    assert {(r.first, r.end) for r in found if r.doc_id == 0} == {(0, n)} and sorted((r.first, r.end) for r in found if r.doc_id == 3) == [(0, n), (n, 2 * n)]


def test_blocks_of_any_size_give_the_same_scores(docs):
    whole = as_rows(LmScore().scores(docs))
    small = as_rows(LmScore(block_bytes=900, range_bytes=500).scores(docs.repartition(7)))
    assert len(whole) == len(small) and all(a[:2] == b[:2] and np.allclose(a[2:], b[2:]) for a, b in zip(whole, small))


def test_no_tables_are_left(spark, docs):
    """All that operators write is under the checkpoint folder and goes with close_all."""
    import os

    from folio.llm import _store

    as_rows(Sharding(3).assign(docs))
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert any(x.startswith("folio-") and os.listdir(f"{at}/{x}") for x in os.listdir(at) if x.startswith("folio-"))
    _store.close_all()
    assert not any(x.startswith("folio-") for x in os.listdir(at))
