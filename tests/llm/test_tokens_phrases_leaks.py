"""Alignment, phrase mining and decontamination against brute force, and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantry.llm import align, decontaminate, phrases, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows and ids, marks of the tokenizers, columns with the operators' names."""
    said = "the quick brown fox jumps over the lazy dog and runs away"
    long = " ".join(f"w{i % 701}" for i in range(30_000))
    rows = [
        (1, said, "en", "a", 1),
        (2, said.upper().replace(" ", "\t "), "en", "a", 1),
        (2, said.upper().replace(" ", "\t "), "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (None, said + ". " + said, "en", "b", 1),
        (5, " \n ", "de", "b", 3),
        (6, long, "de", "b", None),
        (7, long + " " + said, None, None, None),
        (8, "!!! ### 123", "en", "a", 1),
        (9, "x", "fr", "c", 1),
        (10, "a ▁ b <|endoftext|> <s> </s> <unk> <0x41> é́ \U0001f600  z ", "fr", "c", 1),
        (11, "\x00a\r\nb\x0bc d", "fr", "c", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit("x") for n in ["block", "at", "pair", "n", "best", "ids", "prefix", "suffix", "part", "id", "shard", "i", "t", "words", "size", "rows", "items", "spans"]})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- 11 alignment ---


@pytest.fixture(scope="module")
def tokenizers():
    return align.byte_level(queries.vocabulary("byte_bpe_50k.json")), align.piece_level(queries.vocabulary("piece_bpe_32k.model"))


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_diagonal_by_brute_force(data):
    n = data.draw(st.integers(1, 80))
    common = data.draw(st.lists(st.booleans(), min_size=n, max_size=n))
    few = data.draw(st.integers(1, 12))
    cut = [[k + 1 for k in range(n - 1) if common[k] or data.draw(st.integers(0, few)) == 0] + [n] for _ in range(2)]
    a, b = cut
    got = [x.tolist() for x in align.skip_diagonal(np.array(a), np.array(b))]
    both = sorted(set(a) & set(b))
    assert got[:2] == [[a.index(e) + 1 for e in both], [b.index(e) + 1 for e in both]]
    sa, sb = [0, *a[:-1]], [0, *b[:-1]]
    assert list(zip(*got[2:], strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(a[i], b[j])]


def test_byte_level_ids_are_those_of_the_json(tokenizers):
    from tokenizers import Tokenizer
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 64)]
    texts += ["".join(rng.choice(" \t\n\r'sdmtlverXY19.,<|é中\U0001f600́ ") for _ in range(40)) for _ in range(500)]
    texts += ["<|endoftext|>", "a" * 5000, " " * 3000]
    for text in texts:
        assert tokenizers[0].encode(text).tolist() == own.encode(" " + text, add_special_tokens=False).ids


def plain_alignment(text, first, second):
    """(a, b, groups, links) from the definitions."""
    if not text:
        return [], [], [], []
    a, b = first.encode(text).tolist(), second.encode(text).tolist()
    if not first.joined(a) == second.joined(b) == b" " + text.encode():
        return [], [], [], []
    spans = []
    for ids, t in ((a, first), (b, second)):
        ends = np.cumsum([len(t.pieces[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
    both = np.array(sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}))
    at = lambda k, e: np.searchsorted(both, e)
    groups = [([], []) for _ in both]
    for k, ids in enumerate((a, b)):
        for i, (_, e) in zip(ids, spans[k], strict=True):
            groups[at(k, e)][k].append(i)
    links, j = [], 0
    for i, (s, e) in zip(a, spans[0], strict=True):
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(b) and spans[1][k][0] < e:
            links.append((i, b[k]))
            k += 1
    return a, b, groups, links


def plain_counts(docs, first, second):
    all_ = [(r["doc_id"], *plain_alignment(r["text"], first, second)) for r in docs]
    n = collections.Counter(link for *_, links in all_ for link in links)
    most = collections.Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    out = []
    for doc_id, a, b, groups, links in all_:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_by_brute_force(spark, tokenizers):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = plain_counts(docs.collect(), *tokenizers)
    assert rows_of(queries.op11_align(spark, DATA), *NAMES) == want


def test_alignment_odd(spark, odd, empty, tokenizers):
    files = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
    want = plain_counts(odd.collect(), *tokenizers)
    for size in (1, 1 << 20):
        assert rows_of(align.link_counts(odd, *files, block_bytes=size), *NAMES) == want
    by_id = {w[0]: w for w in want}
    assert by_id[3][1:] == by_id[4][1:] == by_id[10][1:] == (0, 0, 0, 0, 0, 0, "")  # 10 has the piece's mark for a space
    assert by_id[8][1] > 0 and by_id[11][1] > 0
    assert align.link_counts(empty, *files).count() == 0
    assert align.link_counts(odd.select("rows", F.col("doc_id").alias("Rows_"), "text"), *files, id_col="Rows_").columns[0] == "Rows_"


def test_groups_column(spark, odd, tokenizers):
    files = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
    for r in align.groups(odd.where("doc_id is null or doc_id in (1, 3, 8, 11)"), *files).collect():
        _, _, groups, _ = plain_alignment(r["text"], *tokenizers)
        assert [(g["a"], g["b"]) for g in r["groups"]] == [tuple(g) for g in groups]
        assert not groups or (r["groups"][0]["start"], r["groups"][-1]["end"]) == (0, len(r["text"].encode()) + 1)
    with pytest.raises(ValueError):
        align.groups(odd, *files, groups_col="BLOCK")


# --- 12 phrases ---


def plain_phrases(docs, least, longest, best, subsumed):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for r in docs:
        lang = r["lang"] or "und"
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (r["text"] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        chosen = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        inside = collections.Counter()
        for p, a in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in chosen.items():
            if p in inside and 100 * inside[p] >= subsumed * a:
                continue
            score, k = min(((2000000 * a) // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        for rank, (score, _, p, a, left, right) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, p.decode(), a, left, right, n[lang], -score))
    return sorted(out, key=repr)


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("least, longest, best, block, part", [(2, 4, 50, 20_000, 3), (3, 5, 2000, 1 << 20, 1 << 20), (30, 2, 7, 5_000, 1)])
def test_phrases_by_brute_force(spark, least, longest, best, block, part):
    """Blocks of a few texts or of all, stripes whole or in many parts, phrases of two words to five."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = phrases.collocations(docs, least=least, longest=longest, best=best, block_bytes=block, part_size=part)
    assert rows_of(got, *PHRASE) == plain_phrases(docs.collect(), least, longest, best, 80)


def test_phrases_odd(spark, odd, empty):
    for least, subsumed in ((2, 80), (2, 101), (1, 60)):
        got = phrases.collocations(odd, least=least, best=1000, subsumed=subsumed, block_bytes=5000)
        assert rows_of(got, *PHRASE) == plain_phrases(odd.collect(), least, 4, 1000, subsumed)
    got = phrases.collocations(empty)
    assert got.count() == 0 and set(got.columns) == set(PHRASE)
    assert phrases.collocations(odd.where("doc_id in (3, 4, 5)"), least=1).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, both = 7 * 10**17 + 1, 15 * 10**17 + 7
    row = spark.createDataFrame([(a, both)], "a long, b long")
    assert row.select(F.call_function("div", 2000000 * phrases._exact("a"), phrases._exact("b"))).first()[0] == 2000000 * a // both


# --- 13 decontamination ---


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_hits(docs, items, window):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(str(item) if item is not None else "")
    sizes = {len(x) for x in windows}
    out = []
    for r in docs:
        w, hit, met = plain_words(r["text"]), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    met |= found
        spans = [s for s in sorted(hit) if s - 1 not in hit]
        ends = [s + 1 for s in sorted(hit) if s + 1 not in hit]
        out.append((r["doc_id"], len(w), len(hit), list(zip(spans, ends, strict=True)), sorted(met, key=str.encode)))
    return sorted(out, key=repr)


def found_hits(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["items"]) for r in df.collect()), key=repr)


@given(st.lists(st.lists(st.integers(1, 3), max_size=12), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_index_by_brute_force(texts):
    """The suffix array orders all suffixes; searching, ranks and locating give every occurrence."""
    counts, bits, sampled, positions = decontaminate.build([np.array(t, np.int64) for t in texts], 3)
    symbols = [s for t in texts for s in (*t, 0)]
    order = decontaminate.suffix_array(np.array(symbols))
    ends = iter(range(len(texts)))
    ranked = [(0, next(ends)) if s == 0 else (1, s) for s in symbols]
    assert order.tolist() == sorted(range(len(symbols)), key=lambda k: ranked[k:])
    index = decontaminate.FMIndex.load(counts, bits, sampled, positions)
    patterns = [p for k in range(1, 5) for p in np.ndindex(*[3] * k)]
    table = np.array([[*(x + 1 for x in p), *[-1] * (4 - len(p))] for p in patterns])
    low, high = index.search(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [k for k in range(len(symbols)) if symbols[k : k + len(p)] == [x + 1 for x in p]]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_long_repeats_are_sorted():
    t = np.array([1, 2] * 3000 + [1] * 500)
    symbols = np.concatenate([t, [0], t, [0], t[1:], [0]])
    order = decontaminate.suffix_array(symbols)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    ends = np.flatnonzero(symbols == 0)
    key = lambda k: tuple(symbols[k : ends[np.searchsorted(ends, k)]].tolist())
    some = order[:: len(order) // 200]
    assert all((*key(a), -1) <= (*key(b), -1) for a, b in zip(some[:-1], some[1:], strict=True))


@pytest.mark.parametrize("shard, block, located", [(1 << 20, 1 << 17, 1 << 20), (300, 700, 7)])
def test_contamination_by_brute_force(spark, shard, block, located, monkeypatch):
    monkeypatch.setattr(decontaminate, "LOCATED", located)
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet").limit(200 if shard > 300 else 100)
    got = decontaminate.contamination(docs, items, shard_words=shard, block_windows=block)
    want = plain_hits(docs.collect(), [tuple(r) for r in items.collect()], 10)
    assert found_hits(got) == want and any(w[2] for w in want)


def test_contamination_odd(spark, odd, empty):
    said = "the quick brown fox jumps over the lazy dog and runs away"
    items = [(1, said), (1, "Quick; BROWN!"), (2, said), (None, "x"), (3, None), (4, ""), (5, "...")]
    items += [(6, "the"), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 " + said), (8, "nowhere to be found at all in any of these texts"), (9, " ".join(f"w{i}" for i in range(400)))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({"words": F.lit("x"), "block": F.lit(1)})
    want = plain_hits(odd.collect(), items, 10)
    for shard, block in ((1 << 20, 1 << 17), (50, 90)):
        assert found_hits(decontaminate.contamination(odd, table, shard_words=shard, block_windows=block)) == want
    assert decontaminate.contamination(empty, table).count() == 0
    clean = decontaminate.contamination(odd, table.limit(0)).collect()
    assert len(clean) == odd.count() and not any(r["n_hit"] or r["items"] or r["spans"] for r in clean)


def test_removal():
    assert decontaminate.remove_hits("One, two; THREE four.", [(1, 3)]) == "One,  four."
    assert decontaminate.remove_hits("One, two", [(0, 2)]) == "" and decontaminate.remove_hits(None, [(0, 1)]) is None and decontaminate.remove_hits("a", []) == "a"
