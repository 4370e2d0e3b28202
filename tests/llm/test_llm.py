import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sievework.llm import base, decontaminate, exact_dedup, langid, packing, pii, simhash, substring_dedup, suffix_dedup, token_store, tokens, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, text_sha256 string, rank int, doc long, h long"


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts += [texts[0]] * 8 + [texts[1].replace(" ", "  \n")] + [f"{a} {passage} {b}" for a, b in zip(texts[2:9], texts[9:16], strict=True)]
    texts += [None, "", " ", "\n\t", "émoji 🔥 ñ", "x " * 20000, texts[3].upper()]
    texts += [t[: t.rfind(" ")] + " changed" for t in texts[20:26] if " " in t]
    out = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


def _df(spark, rows):
    """With an id that is null, a repeated row, and columns whose names operators use inside."""
    some = [(i, t, "en", None, None, None, None) for i, t in [*rows, (None, "no id"), rows[0]]]
    return spark.createDataFrame(some, SCHEMA).repartition(3)


def _groups(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_exact_dedup(spark, rows):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(_df(spark, rows), block_chars=16).collect()}
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert got == {i: (min(g), len(g), i == min(g)) for g in by.values() for i in g}


def test_simhash(spark, rows):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(_df(spark, rows)).collect()}
    fp = {}
    for i, t in rows:
        w = _words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[k : k + 3] for k in range(len(w) - 2)] if len(w) > 2 else [w] if w else [])]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    of = _groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == {(i, f"{fp[i]:016x}", of[i]) for i in fp}


@pytest.mark.parametrize("longest", [2, 64])
def test_links_of_crowded_fingerprints(spark, longest):
    rng, f = np.random.default_rng(1), set()
    for b in rng.integers(0, 2**63, 3, dtype=np.uint64):
        for _ in range(150):
            f.add(int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())))
    f = sorted(f)
    df = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(f)], "fp long, rep long")
    got = {r.id: r.component for r in simhash.components(simhash.links(df, longest=longest)).collect()}
    want = _groups(range(len(f)), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 2])
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates(spark, rows):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(_df(spark, rows)).collect()}
    s = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    near = [(a, b) for a in s for b in s if a < b and s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    want = _groups(s, near)
    assert {i: got.get(i, i) for i in s if s[i]} == {i: want[i] for i in s if s[i]}


def test_near_duplicates_in_a_family(spark):
    """Texts of similarity 0.76, not enough, among them pairs of 0.82."""
    rng = random.Random(9)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(100000)}" for _ in range(n)]
    shared = text(165)
    docs = [(i, " ".join(shared + text(25))) for i in range(500)]
    docs += [(2000 + i, " ".join(docs[i][1].split()[:-18] + text(18))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id >= 2000}
    # a pair of similarity 0.82 is in none of 96 blocks together with a probability of 0.01
    assert got <= {(2000 + i, i) for i in range(80)} and len(got) >= 76


def test_near_duplicates_make_no_rows_of_pairs(spark, monkeypatch):
    """In a family of texts of similarity 0.76 that is four times as large no work table grows as the pairs do, sixteen times."""
    rng = random.Random(9)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(100000)}" for _ in range(n)]
    shared, other, made = text(165), text(100), defaultdict(int)

    class Counted(base.WorkTable):
        def __init__(self, df, name):
            super().__init__(df, name)
            made[name] += self.read().count()

    monkeypatch.setattr(simhash, "WorkTable", Counted)
    for n in (100, 400):
        made.clear()
        docs = [(i, " ".join(shared + text(25))) for i in range(n)] + [(n + i, " ".join(other + text(1))) for i in range(2)]
        assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == {(n, n), (n + 1, n)}
        if n == 100:
            before = dict(made)
    assert made["wide"] == 402 and sum(made.values()) <= 96 * 402 and all(x <= 8 * before[k] + 100 for k, x in made.items())


@pytest.mark.parametrize("most", [simhash.MAP_MOST, 1 << 15])
def test_ids_that_may_be_among_some(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAP_MOST", most)
    docs, ids = spark.range(-1000, 40000), spark.range(-1000, 40000, 17)
    some, rest = ({r.id for r in simhash._perhaps(docs, ids, "id", how).collect()} for how in ("left_semi", "left_anti"))
    assert some >= set(range(-1000, 40000, 17)) and some | rest == set(range(-1000, 40000)) and not some & rest and len(rest) > 35000


def test_near_duplicates_do_not_move_all_texts(spark):
    """Where Spark chooses no broadcast join, two runs write less to shuffles than the texts have once; each turn's join and the
    last one wrote them all."""
    rng = random.Random(3)
    texts = [rng.randbytes(15000).hex(" ", 3) for _ in range(300)]
    texts += [f"{t} more" for t in texts[:3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(), spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite())[1]
    key = "spark.sql.autoBroadcastJoinThreshold"
    limit, before = spark.conf.get(key), written()
    spark.conf.set(key, "-1")
    try:
        assert {r.doc_id for r in simhash.keep_one(df).select("doc_id").collect()} == set(range(300))
        assert simhash.keep_one(df).agg(F.sum(F.length("text"))).first()[0] == sum(map(len, texts[:300]))
    finally:
        spark.conf.set(key, limit)
    assert written() - before < sum(map(len, texts))


def test_substring_dedup(spark, rows, monkeypatch):
    docs = _df(spark, rows)
    first, win = {}, {}
    for i, t in sorted(rows):
        w = _words(t)
        win[i] = [" ".join(w[k : k + 13]) for k in range(len(w) - 12)]
        for x in win[i]:
            first.setdefault(x, i)
    want = {}
    for i, t in rows:
        w = _words(t)
        gone = {p for k, x in enumerate(win[i]) if first[x] < i for p in range(k, k + 13)}
        stay = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(stay.encode()).hexdigest())
    for most in (4096, 1):  # the second: all windows the other exact way
        monkeypatch.setattr(substring_dedup.covered_windows, "__defaults__", (13, 5, most))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
        assert got == want


def test_suffix_dedup(spark, rows):
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(_df(spark, rows)).collect()}
    places = defaultdict(list)
    for i, t in rows:
        w = _words(t)
        for k in range(len(w) - 49):
            places[" ".join(w[k : k + 50])].append((i, k))
    cover, gone, others = defaultdict(set), defaultdict(set), defaultdict(set)
    for p in map(sorted, places.values()):
        least, second = p[0], next((j for j, _ in p if j != p[0][0]), None)
        for i, k in p if len(p) > 1 else []:
            cover[i].update(range(k, k + 50))
            gone[i].update(range(k, k + 50) if (i, k) > least else [])
            others[i].update({second if i == least[0] else least[0]} - {None})
    words_of = lambda spans: {k for s in spans for k in range(s.begin, s.stop)}
    for i, r in got.items():
        assert (words_of(r.spans), words_of(r.gone), set(r.others)) == (cover[i], gone[i], others[i])
        assert (r.n_words, r.n_repeated, r.n_removed) == (len(_words(dict(rows)[i])), len(cover[i]), len(gone[i]))


@pytest.mark.parametrize("longest", [suffix_dedup.LONG, 3])
def test_suffix_dedup_of_passages_that_end_alike(spark, longest, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n))
    # a line that the minimiser falls into
    line = min((text(16) for _ in range(200)), key=lambda x: base.Words(pa.array([x])).grams(8).min())
    heads = [text(36) for _ in range(250)]
    docs = [(i, f"{text(20)} {heads[i % 250]} {line} {text(40)}") for i in range(500)] + [(i, f"{text(30)} {line} {text(60)}") for i in range(500, 900)]
    docs += [(900, f"{heads[0]} {line} {text(9)} {heads[0]} {line}")]
    monkeypatch.setattr(suffix_dedup.repeated_passages, "__defaults__", (50, 8, longest, longest, longest))
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    places = defaultdict(list)
    for i, t in docs:
        w = _words(t)
        for k in range(len(w) - 49):
            places[" ".join(w[k : k + 50])].append((i, k))
    cover, gone, others = defaultdict(set), defaultdict(set), defaultdict(set)
    for p in map(sorted, places.values()):
        least, second = p[0], next((j for j, _ in p if j != p[0][0]), None)
        for i, k in p if len(p) > 1 else []:
            cover[i].update(range(k, k + 50))
            gone[i].update(range(k, k + 50) if (i, k) > least else [])
            others[i].update({second if i == least[0] else least[0]} - {None})
    words_of = lambda spans: {k for s in spans for k in range(s.begin, s.stop)}
    assert {i: (words_of(r.spans), words_of(r.gone), set(r.others)) for i, r in got.items()} == {i: (cover[i], gone[i], others[i]) for i, _ in docs}


@pytest.mark.parametrize("crowded", [suffix_dedup.LONG, 3])
def test_suffix_dedup_of_words_at_a_period(spark, crowded, monkeypatch):
    """Two words in turn, hundreds of times a text, make as many rows as they do dozens of times; the passages are those of brute force."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n))
    made = defaultdict(int)

    class Counted(base.WorkTable):
        def __init__(self, df, name):
            super().__init__(df, name)
            made[name] += self.read().count()

    monkeypatch.setattr(suffix_dedup, "WorkTable", Counted)
    monkeypatch.setattr(suffix_dedup.repeated_passages, "__defaults__", (50, 8, crowded, crowded, crowded))
    heads, before = [text(30) for _ in range(4)], None
    for times in (60, 400):
        made.clear()
        docs = [(i, f"{heads[i % 4]} {'is on ' * (times + i % 3)}{text(20)}") for i in range(12)] + [(12, "one " * 3 * times), (13, "to be or " * times), (14, f"{'on is ' * times}is {heads[1]}")]
        got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        places = defaultdict(list)
        for i, t in docs:
            w = _words(t)
            for k in range(len(w) - 49):
                places[" ".join(w[k : k + 50])].append((i, k))
        cover, gone, others = defaultdict(set), defaultdict(set), defaultdict(set)
        for p in places.values():
            least, second = p[0], next((j for j, _ in p if j != p[0][0]), None)
            for i, k in p if len(p) > 1 else []:
                cover[i].update(range(k, k + 50))
                gone[i].update(range(k, k + 50) if (i, k) > least else [])
                others[i].update({second if i == least[0] else least[0]} - {None})
        words_of = lambda spans: {k for s in spans for k in range(s.begin, s.stop)}
        assert {i: (words_of(r.spans), words_of(r.gone), set(r.others)) for i, r in got.items()} == {i: (cover[i], gone[i], others[i]) for i, _ in docs}
        before = before or dict(made)
    assert all(x <= before[k] + 30 for k, x in made.items()), (before, dict(made))


def test_decontaminate(spark, rows):
    text = dict(rows)
    items = [(1, " ".join(_words(text[2])[:40])), (2, "w1 w2"), (3, None), (4, ""), (10, text[5]), (2, "w7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 1):  # the second: a shard an item
        got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in decontaminate.contamination(_df(spark, rows), bench, shard_bytes=size).collect()}
        for i, t in rows:
            w, hit, found = decontaminate.words(t), set(), set()
            for item, x in items:
                p = decontaminate.words(x)
                m = min(13, len(p))
                for k in range(len(p) - m + 1 if m else 0):
                    for j in range(len(w) - m + 1):
                        if w[j : j + m] == p[k : k + m]:
                            hit.update(range(j, j + m))
                            found.add(item)
            assert got[i] == (len(w), len(hit), sorted(found))


def test_encoders_agree_with_the_library():
    rng = random.Random(2)
    parts = [*"abc'sdtrevml  \t\n\r\x0b\x0c\x00\x1b019.,!?<|>_-ÀéßıŁĿXYZ", "'s", "  ", "İ", "Ω", "²", "\x1c", "\xa0", "中", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        short, plain = tokens.ArrayEncoder(path, kind), tokens.Encoder(path, "none")
        assert all(np.array_equal(a, b) for a, b in zip(short.encode(pa.array(texts)), plain.encode(texts), strict=True))


def _spelt(prefix, n):
    return prefix + "".join("abcdefghij"[int(c)] for c in str(n))


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_encoder_keeps_frequent_words_when_memory_is_full(monkeypatch, path, kind):
    monkeypatch.setattr(tokens, "CACHE", 300)
    short, plain, learned = tokens.ArrayEncoder(path, kind), tokens.Encoder(path, "none"), []
    add = short._add
    monkeypatch.setattr(short, "_add", lambda words, *rest: (learned.extend(w if isinstance(w, str) else w.decode() for w in words), add(words, *rest))[1])
    frequent = [_spelt("fr", i) for i in range(100)] + ["unübersehbareswortungetüm"]  # over 16 bytes
    for batch in range(20):
        texts = [" " + " ".join(frequent), " ".join(_spelt("new" + "xyz"[batch % 3], batch * 1000 + i) for i in range(60))]
        assert all(np.array_equal(a, b) for a, b in zip(short.encode(pa.array(texts)), plain.encode(texts), strict=True))
    learned = [w.strip() for w in learned]
    assert {learned.count(w) for w in frequent} == {1} and short.count <= 300
    texts = [" ".join(_spelt("much", i) for i in range(2000)), "fr"]  # more at once than may stay
    assert all(np.array_equal(a, b) for _ in range(3) for a, b in zip(short.encode(pa.array(texts)), plain.encode(texts), strict=True))


@pytest.mark.parametrize("spread", [lambda x: np.zeros_like(x), lambda x: x % np.uint64(7)])
def test_encoder_where_hashes_agree(monkeypatch, spread):
    monkeypatch.setattr(tokens, "mix", spread)
    texts = [" ".join(_spelt("a" * (i % 20), i + j) for j in range(10)) for i in range(300)]
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        short, plain = tokens.ArrayEncoder(path, kind), tokens.Encoder(path, "none")
        for i in range(0, 300, 50):
            part = [None, "", *texts[max(0, i - 50) : i + 50]]
            assert all(np.array_equal(a, b) for a, b in zip(short.encode(pa.array(part)), plain.encode([t or "" for t in part]), strict=True))


def test_encoder_of_other_spellings(monkeypatch):
    """A vocabulary whose model doesn't spell bytes as expected: the library encodes each word."""
    monkeypatch.setattr(tokens, "_spelled", lambda words: ["?" for _ in words])
    texts = ["one two  three Öl 12 ?!", "", "naïve"]
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        short, plain = tokens.ArrayEncoder(path, kind), tokens.Encoder(path, "none")
        assert not short.direct and all(np.array_equal(a, b) for a, b in zip(short.encode(pa.array(texts)), plain.encode(texts), strict=True))


def test_chunks_are_cut_as_each_document_alone():
    def alone(ids):
        ends, last, n = [], 0, len(ids)
        for e in range(1, n + 1):
            run = ids[max(0, e - token_store.SPAN) : e][::-1]
            h = sum((int(x) + 1) * 0x9E3779B97F4A7C15 * 0xD1342543DE82EF95**j for j, x in enumerate(run)) % (1 << 64)
            h ^= h >> 32
            if e == n or e - last >= token_store.LEAST and (h % (1 << token_store.BITS) == 0 or e - last == token_store.MOST):
                ends.append(e)
                last = e
        return ends

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50257, n).astype("<u2") for n in (0, 1, 7, 256, 257, 0, 3000, 9000, 20000)] + [np.full(9000, 5, "<u2")]
    at = np.cumsum([0, *map(len, docs)]).tolist()
    assert token_store.cuts(np.concatenate(docs), at) == [alone(d) for d in docs]


def test_token_store_round_trip(spark, rows, tmp_path):
    token_store.write(_df(spark, rows), str(tmp_path / "s"), BYTE, "byte")
    got = {(r.doc, r.start, r.n_tokens, r.crc) for r in token_store.read(spark, str(tmp_path / "s"), token_store.crc_of, "crc long").collect()}
    want, start, plain = set(), 0, tokens.Encoder(BYTE, "none")
    for i, t in sorted(rows):
        ids = np.append(plain.encode([t or ""])[0], np.uint32(2)).astype("<u4")
        want.add((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_packing(spark, rows):
    got = packing.pack(_df(spark, rows), WORD, "word").collect()
    plain, by, seq = tokens.Encoder(WORD, "none"), defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in rows:
        ids, at = np.append(plain.encode([t or ""])[0], np.uint32(2)).astype("<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0


def test_language_id(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ba", "be", "bo"], "bb": ["ki", "ku", "ka"], "cc": ["so", "su", "zi"]}
    docs = [(i, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(30)), k) for i, (k, s) in enumerate(list(syllables.items()) * 60)]
    df = spark.createDataFrame([*docs, (900, None, "aa"), (901, "123 ²", None), (902, "", "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(df.where("doc_id % 3 <> 1 OR doc_id > 90"))).collect()}
    assert all(got[i].lang_pred == k for i, _, k in docs) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    none = langid.fit(df.where("lang IS NULL"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(1)
    clean = [f"word{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    docs = []
    for i in range(400):
        w, bad = [rng.choice(clean) for _ in range(80)], i % 5 == 0
        if bad:
            w[30:33] = ["vileness", "filthy", "vileness"]
        docs.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs if i < 300] + [(950, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, toxicity.fit(df, labels)).collect()}
    assert all(got[i].predicted == y and (not y or got[i].passages[0].begin >= 29) for i, _, y in docs) and got[900].predicted == got[901].predicted == 0
    assert toxicity.toxicity(df, toxicity.fit(df, labels.where("false"))).count() == 402


def _maximal(x, first=0):
    """The definition: the segment of the highest score (the shortest, then the first), and those of what is left of it and right of it."""
    best = max(((sum(x[i:j]), i - j, -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return [*_maximal(x[:i], first), (first + i, first + j, best[0]), *_maximal(x[j:], first + j)]


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(300):
        y = [rng.choice([-7, -5, -3, -1, 2, 4, 8, 16]) + rng.random() for _ in range(rng.randint(0, 25))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(y, float))] == [(a, b) for a, b, _ in _maximal(y)]
    begin = time.perf_counter()
    for y in (np.tile([1.0, -2.0], 500_000), np.tile([2.0, -1.0], 500_000), np.random.default_rng(1).normal(-0.5, 1, 1_000_000)):
        assert toxicity.segments(y)
    assert time.perf_counter() - begin < 30
    x = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float)
    assert [(a, b, s) for a, b, s in toxicity.segments(x)] == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]


def test_pii(spark):
    texts = ["mail a.b@c.org or 1.2.3.4, 300.1.1.1", "card 4111 1111 1111 1111 and 4111111111111112", "+1 (555) 555-0100 call 555-123-4567", "🔥é write to me (at) site (dot) com", None, "", "1 " * 3000, "a" * 50000, "1234567890" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_pii(df)
    got = {r.doc_id: r for r in found.collect()}
    assert [(s.begin, s.stop) for s in got[0].email] == [(5, 14)] and [(s.begin, s.stop) for s in got[0].ip] == [(18, 25)]
    assert len(got[1].card) == 1 and len(got[2].phone) == 1 and not got[6].card and not got[8].card
    assert [(s.kind, texts[3][s.begin : s.stop]) for s in got[3].added] == [("email", "me (at) site (dot) com")]
    assert "<card>" in {r.doc_id: r.text for r in pii.redact(df, found).collect()}[1]


def _base_spans(text):
    """By the definition of each kind, with Python's patterns."""
    digits = lambda v: [int(c) for c in v if c.isdigit()]
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    )
    return {k: [m.span() for m in re.finditer(p, text or "") if fits(m[0])] for k, p, fits in kinds}


def test_base_spans_equal_the_definition(spark):
    rng = random.Random(8)
    parts = [*"0123456789" * 2, *"+-. ()@_%:ab", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "a.b@c.org", "+1 (555) 555-0100", "🔥", "é", "\n", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["x " * 100_000 + "a@b.co", "1" * 30_000, "a@" * 5000, "+1 " * 5000, "1.1." * 5000, "4111111111111111 " * 2000]
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    every = [*texts, *real]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(4)).collect()}
    for i, t in enumerate(every):
        assert {k: [(x.begin, x.stop) for x in got[i][k]] for k in pii.KINDS} == _base_spans(t)


def test_added_spans(spark):
    hold = ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "call (555) 123-4567 now", "write to me (at) site (dot) com", "api_key: Zk3jd83JKd93kdkKDJ39dkf83"]
    clean = ["version 2024-01-02 10:20", "order 2669109448945250 shipped", "src/main/java/org/example/thing1/part", "see the_long_name_of_a_function_2 there", "a + b at c . d", "chapter 12.345.678", "1000 2000 3000"]
    df = spark.createDataFrame(list(enumerate([*hold, *clean])), "doc_id long, text string")
    got = {r.doc_id: [x.kind for x in r.added] for r in pii.find_pii(df).collect()}
    assert [got[i] for i in range(4)] == [["secret"], ["phone"], ["email"], ["secret"]] and not any(got[i] for i in range(4, len(got)))


def test_pipeline_stages(spark, rows, tmp_path):
    """Each stage against its definition on all that the one before kept; documents keep their columns, rows without an id go."""
    import corpus_pipeline

    text = dict(rows)
    out = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    docs = _df(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    words, shingles = {i: decontaminate.words(t) for i, t in rows}, {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    bench = spark.createDataFrame([(1, " ".join(words[2][:40])), (2, text[5])], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = out(docs.where("doc_id IS NOT NULL")), stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.where("doc_id IS NULL").isEmpty()
        after = out(kept)
        if name == "language_id":  # two languages that nothing tells apart: what has no letter goes, what else is the model's to say
            assert not any(not any(map(str.isalpha, t or "")) for t in after.values()) and set(after) <= set(before)
            kept = docs  # the next stages get all
        elif name == "exact_dedup":
            by = {}
            for i, t in sorted(before.items()):
                by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
            assert set(after) == set(by.values())
        elif name == "near_dedup":
            near = [(a, b) for a in before for b in before if a < b and shingles[a] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
            assert set(after) == {i for i, top in _groups(before, near).items() if i == top}
        else:
            bad = {r.doc_id for r in decontaminate.contamination(docs, bench).where("contaminated").collect()}
            assert bad and set(after) == set(before) - bad
        assert all(after[i] == before[i] for i in after)
        docs = kept
    ids = {i for i in out(docs)}
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == ids
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_that_agree_in_a_polynomial_hash(spark):
    """Thue-Morse words: equal under any polynomial modulo 2^64."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    a, b = "x" * 8 + a, "x" * 8 + a.translate(str.maketrans("ab", "ba"))
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        short, plain = tokens.ArrayEncoder(path, kind), tokens.Encoder(path, "none")
        assert all(np.array_equal(x, y) for x, y in zip(short.encode(pa.array([a, b])), plain.encode([a, b]), strict=True))
    for n, run in ((12, lambda d: substring_dedup.substring_dedup(d)), (49, lambda d: suffix_dedup.suffix_dedup(d))):
        same = " ".join(f"w{i}" for i in range(n))
        df = spark.createDataFrame([(1, f"{same} {a}"), (2, f"{same} {b}")], "doc_id long, text string")
        assert {r.n_removed for r in run(df).collect()} == {0}


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, simhash.simhash_components, simhash.near_duplicates, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, pii.find_pii, lambda d: packing.pack(d, WORD, "word"), lambda d: decontaminate.contamination(d, d.selectExpr("doc_id AS item_id", "text")), lambda d: langid.identify(d, langid.fit(d)), lambda d: toxicity.toxicity(d, toxicity.fit(d, d.selectExpr("doc_id", "rank AS toxic")))])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
