"""Every training-data operator against a brute-force version, a round trip or held-out accuracy, with the defined
cases: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, other columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stairlight.llm import common, components, decontamination, fingerprints, katz, language_id, near_dedup, packing, quality, queries, sharding, substring_dedup, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ba", "do", "ki", "lu", "me", "") for b in ("ra", "so", "ti", "nu") for c in ("", "n", "s")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    docs = [" ".join(rng.choices(WORDS, k=rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choices(WORDS, k=60))
    for i in range(0, n, 9):
        docs[i] = docs[i] + "\n" + passage + " tail" + str(i)
    docs[7] = docs[3]
    docs[11] = docs[3]
    near = docs[5].split() * 2
    near[len(near) // 2] = "changed"
    docs[5], docs[13] = " ".join(docs[5].split() * 2), " ".join(near)
    docs += [None, "", "   \t ", "Ünïcode ÀÉß \x0b x", "a " * 30, " ".join(rng.choices(WORDS, k=6000))]
    return docs


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Read from files, with columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "s0", "s0", "s1"][i % 4], len(t or "")) for i, t in enumerate(corpus())]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("anchor", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("n", F.lit(3))
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null ids, repeated rows and nulls everywhere."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame([(None, None, None, None, None), (1, "one two three four five six", "en", "s", 3), (1, "one two three four five six", "en", "s", 3), (None, "one two three four five six", None, None, 1), (2, None, "en", None, None)], SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


# --- common ---------------------------------------------------------------------------------------------------


def test_word_hashes_follow_words():
    texts = ["a bb  a\tccc", None, "", "bb", " a", "x" * 70_000 + " a", "ä b"]
    data, offsets = common.text_buffers(pa.array(texts))
    w = common.Words(data, offsets)
    flat = [x for t in texts for x in words(t)]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(flat, w.hashes.tolist()))) == len(set(flat)) == len(set(w.hashes.tolist()))


def test_pieces_cover_all_documents():
    offsets = np.array([0, 5, 5, 40, 41, 60])
    got = list(common.pieces_of(offsets, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(5))
    assert list(common.pieces_of(np.array([0]))) == []


@pytest.mark.parametrize("small", [components.SMALL, 0])
def test_components(spark, small):
    edges = [(1, 2), (2, 3), (7, 6), (6, 9), (9, 9), (4, 3), (20, 21), (21, 22), (22, 23), (23, 24), (30, 20)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["vertex"]: r["component"] for r in components.components(df, common.Scratch(spark, "t"), "c", small).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 7: 6, 9: 6, 21: 20, 22: 20, 23: 20, 24: 20, 30: 20}
    assert components.components(df.filter("false"), common.Scratch(spark, "t"), "c", small).count() == 0


def test_components_of_random_graphs():
    rng = np.random.default_rng(1)
    for n in (3, 40, 400):
        u, v = rng.integers(-n, n, n), rng.integers(-n, n, n)
        at = {int(x): int(x) for x in [*u, *v]}
        for a, b in zip(u.tolist(), v.tolist()):
            one, two = sorted((at[a], at[b]))
            at = {k: one if x == two else x for k, x in at.items()}
        vertex, component = components.labelled(u, v)
        assert dict(zip(vertex.tolist(), component.tolist())) == at


# --- 1 packing ------------------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_word_encoder_equals_tokenizer():
    path, tok = tokenizer()
    enc = packing.WordEncoder(path, limit=50)
    for t in [*[x or "" for x in corpus()], "A'S it''s <|endoftext|> x", "½ ² ẞ İ Σας a\u0085b\x1cd é ÷×", "'LL 'Re don't !'s 中文 字𝒳"]:
        assert np.frombuffer(enc.text(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_go_through_the_whole_tokenizer(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    tok = Tokenizer(models.BPE({"a": 0, " ": 1, "a ": 2, "A": 3, "b": 4, "?": 5}, [("a", " ")], unk_token="?"))
    tok.pre_tokenizer, tok.normalizer = pre_tokenizers.Split("x", "isolated"), normalizers.NFD()
    tok.save(str(tmp_path / "t.json"))
    enc = packing.WordEncoder(str(tmp_path / "t.json"))
    for t in ["a a b", "A  a", ""]:
        assert np.frombuffer(enc.text(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert not enc.known and packing.WordEncoder(tokenizer()[0]).known


@pytest.mark.parametrize(("length", "group"), [(64, 2), (4096, 256)])
def test_packing_round_trip(docs, texts, length, group):
    path, tok = tokenizer()
    rows = packing.pack(docs, path, length=length, open_windows=4, split_gap=8, group=group).toPandas()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    for i, own in rows.sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(own["ids"]), "<u4").tolist() == ids[i]
        assert (own["doc_tokens"] == len(ids[i])).all() and own["start"].tolist() == [0, *own["length"].cumsum()[:-1]]
    assert set(rows["doc_id"]) == set(ids) and all(zlib.crc32(b) == c for b, c in zip(rows["ids"], rows["ids_crc32"]))
    used = []
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
        used.append(own["length"].sum())
    assert max(used) <= length and sorted(used)[1] > length - 8


def test_packing_defined_cases(empty, odd):
    path, _ = tokenizer()
    assert packing.pack(empty, path).count() == 0
    rows = packing.pack(odd, path).toPandas()
    assert len(rows) == 5 and rows["doc_id"].isna().sum() == 2 and (rows["length"] == 1).sum() == 2


# --- 2 sharding -----------------------------------------------------------------------------------------------


def test_sharding_law_and_mixture(spark, docs, texts):
    rows = sharding.shard(docs, shards=5).toPandas()
    assert rows["doc_id"].tolist().__len__() == len(texts)
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 5
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert sorted(rows["position"]) == list(range(len(texts)))
    share = rows.assign(source=rows["source"].fillna("-")).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (share.max(axis=1) - share.min(axis=1)).max() <= 2
    for r in rows.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)


def test_sharding_order_is_by_fractional_rank(docs):
    rows = sharding.shard(docs, shards=3).toPandas().sort_values("position")
    n = rows["source"].fillna("-").map(rows["source"].fillna("-").value_counts())
    assert ((rows["rank"] + 0.5) / n).is_monotonic_increasing


def test_sharding_defined_cases(empty, odd):
    assert sharding.shard(empty).count() == 0
    rows = sharding.shard(odd, shards=2).toPandas()
    assert len(rows) == 5 and sorted(rows["position"]) == list(range(5))


# --- 3 decontamination ----------------------------------------------------------------------------------------


def damaged(item, rate, rng):
    out = []
    for w in item:
        r = rng.random()
        out += [rng.choice(WORDS)] if r < rate / 2 else [] if r < rate else [w]
    return out


@pytest.mark.parametrize(("rate", "recall"), [(0.0, 1.0), (0.08, 0.9)])
def test_decontamination_recall_against_edit_distance(spark, rate, recall):
    rng = random.Random(5)
    items = [[rng.choice(WORDS) for _ in range(rng.randint(7, 50))] for _ in range(25)]
    rows, expected = [], set()
    for k, item in enumerate(items):
        body = [rng.choice(WORDS) for _ in range(80)]
        own, at = damaged(item, rate, rng), rng.randint(0, 80)
        text = body[:at] + own + body[at:]
        rows.append((k, " ".join(text).upper() if k % 2 else "; ".join(text)))
        if decontamination.edit_distance(np.array([hash(w) for w in item]), np.array([hash(w) for w in text]))[0] <= int(0.2 * len(item) + 1e-9):
            expected.add((k, k))
    rows += [(100 + k, " ".join(rng.choices(WORDS, k=150))) for k in range(30)] + [(None, None), (200, "")]
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(None, None), (98, ""), (99, "a b")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, benchmark, block_items=7).collect()}
    assert len(found & expected) >= recall * len(expected) and found <= expected
    kept = {r["doc_id"] for r in decontamination.remove(docs, benchmark).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in found}


def edited(item, edits, rng):
    """The item after so many edits of words: put in, left out, changed."""
    out = list(item)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["new" + rng.choice(WORDS)], [out[at], "new" + rng.choice(WORDS)]])
    return out


@pytest.mark.parametrize("length", [1, 4, 5, 6, 8, 10, 12, 15, 16, 20, 30, 45, 60, 90])
def test_decontamination_recall_at_the_stated_similarity(length):
    rng, every, found = random.Random(length), [0, 0], [0, 0]
    for turn in range(10):
        items = [[rng.choice(WORDS) + rng.choice(WORDS) for _ in range(length)] for _ in range(30)]
        slack = int(0.2 * length + 1e-9) if length >= 5 else 0
        held = decontamination.Items(list(range(30)), pa.array([" ".join(i) for i in items]), 0.8, 5)
        for kind, edits in enumerate((0, slack)):
            texts = [" ".join(rng.choices(WORDS, k=20) + edited(i, edits, rng) + rng.choices(WORDS, k=20 * (turn % 2))) for i in items]
            hits = set()
            for _, _, w in common.batches_of_words(pa.array(texts), common.ALNUM_WORDS, common.LOWER):
                for d, i, at, n, distance in held.hits(w.hashes, w.first):
                    own = w.hashes[w.first[d] : w.first[d + 1]]
                    hits.add((d, i))
                    assert distance <= slack and distance == decontamination.edit_distance(held.symbols[i], own[at : at + n])[0] and 0 <= at <= at + n <= len(own)
            every[kind] += 30
            found[kind] += sum((k, k) in hits for k in range(30))
    assert found[0] == every[0]  # unedited copies are never missed
    assert found[1] >= 0.95 * every[1]
    print(length, "walks", len(held.walks), "recall", found[1] / every[1])


def test_decontamination_holds_one_block_at_a_time(spark):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choices(WORDS, k=12))) for k in range(20)]
    docs = spark.createDataFrame([(k, "x y z " + t) for k, t in items] + [(7, "x y z " + items[7][1]), (50, "none " * 4000), (None, items[3][1])], "doc_id long, text string")
    benchmark = spark.createDataFrame(items + [items[2]], "item_id long, text string")
    one = decontamination.find(docs, benchmark)
    many = decontamination.find(docs, benchmark, block_items=2)
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["item_id"], r["start_word"], r["distance"]) for r in one.collect())
    assert rows == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["item_id"], r["start_word"], r["distance"]) for r in many.collect())
    assert rows == sorted([(False, k, k, 3, 0) for k in range(20)] + [(False, 2, 2, 3, 0), (False, 7, 7, 3, 0), (True, 0, 3, 0, 0)])
    left = decontamination.remove(docs.withColumn("c0", F.lit("own")), benchmark, block_items=5)
    assert left.columns == ["doc_id", "text", "c0"] and [r["doc_id"] for r in left.collect()] == [50]


def test_decontamination_of_short_items_and_unspaced_scripts(spark):
    zh, ja, th = "机器学习是人工智能的一个重要分支", "東京は日本の首都であり世界最大の都市の一つです", "กรุงเทพเป็นเมืองหลวงของประเทศไทย"
    items = [(1, "forty two"), (2, "Ja"), (3, zh), (4, ja), (5, th), (6, "\U00020000\U00020001"), (7, ""), (8, "한국어 문장")]
    texts = ["it is Forty-two, ja!", "forty and two jar", f"前言{zh}。后记ABC", "首先" + zh.replace("人工", "人造") + "完", f"x{ja}y", ja[:9], "ก" + th + "ข", "\U00020000\U00020001\U00020002", "\U00020001\U00020000", "한국어 문장 둘", "한국어 문장들"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["distance"], r["start_word"], r["n_words"]) for r in decontamination.find(docs, benchmark).collect()}
    assert found == {(0, 1): (0, 2, 2), (0, 2): (0, 4, 1), (2, 3): (0, 2, len(zh)), (3, 3): (1, 2, len(zh)), (4, 4): (0, 1, len(ja)), (6, 5): (0, 1, len(th)), (7, 6): (0, 0, 2), (9, 8): (0, 0, 2)}
    assert {r["doc_id"] for r in decontamination.remove(docs, benchmark).collect()} == {1, 5, 8, 10}


def test_edit_distance_against_brute_force():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(150):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(lo, 7))] for lo in (1, 0))
        distance, s, e = decontamination.edit_distance(np.array(a), np.array(b, int))
        assert distance == min(brute(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == brute(a, b[s:e])


def test_decontamination_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find(docs, none).count() == 0 and decontamination.remove(docs, none).count() == docs.count()
    assert decontamination.find(empty, none).count() == 0


# --- 4 language model -----------------------------------------------------------------------------------------


def good_turing(counts):
    """Discounted counts, written down from the formulas: Katz's factors, else Turing's over a fitted line, else half a
    count less."""
    of = Counter(counts.values())
    n = [of[r] for r in range(1, 7)]
    if all(n) and 6 * n[5] / n[0] < 1:
        tail = 6 * n[5] / n[0]
        factors = [((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) for r in range(1, 6)]
        if all(0 < f < 1 for f in factors):
            return {g: c * factors[c - 1] if c <= 5 else c for g, c in counts.items()}
    points = [(math.log(r), math.log(x)) for r, x in enumerate(n, 1) if x]
    mean = [sum(p[k] for p in points) / max(len(points), 1) for k in (0, 1)]
    slope = sum((x - mean[0]) * (y - mean[1]) for x, y in points) / sum((x - mean[0]) ** 2 for x, _ in points) if len(points) > 1 else 0.0
    if slope >= -1:
        return {g: max(c - 0.5, 0) for g, c in counts.items()}
    return {g: c * (1 + 1 / c) ** (slope + 1) if c <= 5 else c for g, c in counts.items()}


def brute_katz(texts, train, order):
    tokens = {i: [*words(fold(t)), None] for i, t in texts.items()}
    tables = {k: Counter((*(["<s>"] * (k - 1) + tokens[i])[at : at + k],) for i in train for at in range(len(tokens[i]))) for k in range(1, order + 1)}
    kept = {k: good_turing(t) for k, t in tables.items()}
    n = sum(tables[1].values())
    unknown = 1 - sum(kept[1].values()) / n
    followers = {k: defaultdict(list) for k in tables}
    for k, t in tables.items():
        for g in t:
            followers[k][g[:-1]].append(g[-1])
    weights = {}

    def p(context, word):
        k = len(context) + 1
        if k == 1:
            return kept[1][word,] / n if (word,) in kept[1] else unknown
        own = followers[k].get(context)
        if not own:
            return p(context[1:], word)
        if context not in weights:
            total, free = sum(tables[k][(*context, w)] for w in own), sum(kept[k][(*context, w)] for w in own)
            total = total if total - free > 1e-9 * max(total, 1) else total + 1
            weights[context] = total, (1 - free / total) / (1 - sum(p(context[1:], w) for w in own))
        total, weight = weights[context]
        gram = (*context, word)
        return kept[k][gram] / total if gram in tables[k] else weight * p(context[1:], word)

    score = lambda t: sum(math.log10(p(tuple((["<s>"] * (order - 1) + t)[at : at + order - 1]), w)) for at, w in enumerate(t))
    every = [w for (w,) in tables[1]]
    sums = [sum(p(c, w) for w in every) + p(c, "never seen") for c in [*list(followers[order])[:15], ("unknown context",) * (order - 1)]]
    base = lambda w: math.log10((tables[1][w,] + 0.5) / (n + 0.5 * (len(every) + 1)))
    return {i: (score(t), sum(map(base, t)), len(t), sum((w,) in tables[1] for w in t)) for i, t in tokens.items()}, n, sums


@pytest.mark.parametrize(("order", "part"), [(2, 3000), (3, 3000), (4, 20_000)])
def test_katz_against_brute_force(docs, texts, order, part):
    got = {r["doc_id"]: r for r in katz.score(docs, "doc_id % 5 <> 1", order, piece_bytes=2000, part_bytes=part).collect()}
    expected, n, sums = brute_katz(texts, [i for i in texts if i % 5 != 1], order)
    assert sums == pytest.approx([1] * len(sums)) and set(got) == set(texts)
    for i, (score, base, tokens, known) in expected.items():
        r = got[i]
        assert (r["score"], r["base_score"]) == pytest.approx((score, base))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, i % 5 == 1)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_stored_model(spark, docs, texts, order, tmp_path):
    katz.fit(docs.filter("doc_id % 5 <> 1"), f"file://{tmp_path}/model", order, piece_bytes=2000, part_bytes=3000)
    both = {r["doc_id"]: r for r in katz.score(docs, "doc_id % 5 <> 1", order, piece_bytes=2000, part_bytes=3000).collect()}
    for r in katz.score_with(docs, f"file://{tmp_path}/model", piece_bytes=5000).collect():
        own = both[r["doc_id"]]
        assert (r["score"], r["base_score"]) == pytest.approx((own["score"], own["base_score"])) and r["held_out"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (own["n_tokens"], own["n_known"], own["train_tokens"])


def test_katz_refuses_other_splits(spark, docs):
    piece = katz.Piece(*common.text_buffers(pa.array(["a b", "c"])), np.ones(2, bool), 4)
    folder = spark.conf.get("spark.checkpoint.dir") + "/katz-splits"
    rows = [(p, 0, zlib.crc32(b"other").to_bytes(4, "little")) for p in range(4)]
    katz._by_piece(spark.createDataFrame([(p, bytearray(b), n) for p, n, b in rows], "p int, body binary, piece long"), folder)
    with pytest.raises(RuntimeError, match="other pieces"):
        katz._counts(folder, 0, piece)


def test_katz_defined_cases(empty, odd, docs):
    assert katz.score(empty, "true").count() == 0
    rows = katz.score(odd, "true").collect()
    assert len(rows) == 5 and sum(r["doc_id"] is None for r in rows) == 2 and sorted(r["n_tokens"] for r in rows) == [1, 1, 7, 7, 7]
    assert all(r["score"] == r["base_score"] == 0 and r["held_out"] for r in katz.score(docs, "false").collect())


def test_good_turing_factors():
    d = katz.Discounts(np.array([1000, 400, 220, 140, 100, 75]))
    assert not d.all and ((d.factors[1:] > 0) & (d.factors[1:] < 1)).all()
    assert katz.Discounts(np.zeros(6, int)).all and katz.Discounts(np.array([5, 0, 0, 0, 0, 0])).all


# --- 5 substring dedup ----------------------------------------------------------------------------------------


def brute_dedup(texts, window):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = w, gone
    return out


@pytest.mark.parametrize(("window", "many"), [(20, 2048), (20, 2), (9, 3)])
def test_substring_dedup_against_brute_force(docs, texts, window, many, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    got = {r["doc_id"]: r for r in substring_dedup.removal_digests(docs, window).collect()}
    expected = brute_dedup(texts, window)
    assert set(got) == set(texts) and sum(sum(g) for _, g in expected.values()) > 100
    for i, (w, gone) in expected.items():
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_remove_repeats_keeps_columns(docs, texts):
    rows = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, 20).collect()}
    assert list(rows[0].asDict()) == docs.columns
    for i, (w, gone) in brute_dedup(texts, 20).items():
        assert rows[i]["text"] == texts[i] if not any(gone) else words(rows[i]["text"]) == [x for x, g in zip(w, gone) if not g]


def test_substring_dedup_defined_cases(empty, odd):
    assert substring_dedup.removal_digests(empty).count() == 0
    rows = substring_dedup.removal_digests(odd, 3).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in rows) == [(False, 0, 0), (False, 6, 6), (False, 6, 6), (True, 0, 0), (True, 6, 0)]


@pytest.mark.parametrize("key", [5, None])
def test_substring_dedup_of_different_texts_of_one_id(spark, key):
    rng = random.Random(4)
    passage, whole = " ".join(rng.choices(WORDS, k=25)), " ".join(rng.choices(WORDS, k=40))
    own = [" ".join(rng.choices(WORDS, k=30)) for _ in range(4)]
    # an id of three texts: one holds a passage of the first document, one copies it whole, one is clean; two share a passage
    rows = [(-9, own[0] + " " + passage), (-8, whole), (key, own[1] + " " + passage), (key, whole), (key, own[2]), (key, own[3] + " " + own[2])]
    if key is None:  # null comes first
        rows = [(9, t) if k is not None else (None, t) for k, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("v", F.lit(1)).withColumn("clash", F.lit("x")).withColumn("_ranges", F.lit("y")).withColumn("_copy", F.lit(2)).withColumn("_row", F.lit(3))
    kept = [(r["doc_id"], r["text"]) for r in substring_dedup.remove_repeats(df, 20).collect()]
    digests = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.removal_digests(df, 20).collect())
    order = {(k, t): i for i, (k, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark.range(1).select(F.xxhash64(F.lit(r[1]))).first()[0])))}
    expected = brute_dedup({i: t for (_, t), i in order.items()}, 20)
    left = {r: " ".join(w for w, g in zip(*expected[i]) if not g) for r, i in order.items()}
    assert sum(left[r] != r[1] for r in rows) == 3
    assert Counter(kept) == Counter((r[0], left[r]) for r in rows)
    assert digests == Counter((r[0], len(r[1].split()), len(r[1].split()) - len(left[r].split()), hashlib.sha256(left[r].encode()).hexdigest()) for r in rows)


def test_substring_dedup_of_a_window_in_very_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id").cast("string"), F.lit(passage), F.col("id").cast("string"), F.lit("z")).alias("text"))
    rows = substring_dedup.removal_digests(df, 20).groupBy("n_words", "n_removed").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("d")).collect()
    assert sorted(tuple(r) for r in rows) == [(34, 0, 1, 0), (34, 30, 5999, 1)]


def test_stretch_names_follow_words():
    h = np.array([5, 6, 7, 5, 6, 7, 5, 6], np.uint64)
    names = substring_dedup.stretch_names(h, np.array([0, 3, 1, 0, 5]), np.array([3, 6, 4, 2, 8]))
    assert names[0] == names[1] and len(set(names.tolist())) == 4


def test_suffix_automaton_matching():
    rng = random.Random(1)
    texts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 30))] for _ in range(6)]
    automaton = substring_dedup.SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    assert len(automaton.link) <= 2 * sum(map(len, texts)) + 1
    probe = [rng.randint(0, 3) for _ in range(60)]
    inside = lambda s: any(t[k : k + len(s)] == s for t in texts for k in range(len(t)))
    assert automaton.matching(probe) == [max([n for n in range(1, e + 1) if inside(probe[e - n : e])], default=0) for e in range(1, 61)]


def test_remove_reference(spark, docs, texts):
    reference = spark.createDataFrame([(texts[0],), (texts[5],), (None,)], "text string")
    rows = {r["doc_id"]: r for r in substring_dedup.remove_reference(docs, reference, 20, shard_words=100).collect()}
    held = {tuple(words(t)[s : s + 20]) for t in (texts[0], texts[5]) for s in range(len(words(t)) - 19)}
    for i, t in texts.items():
        w = words(t)
        gone = [any(tuple(w[s : s + 20]) in held for s in range(max(0, k - 19), k + 1) if s + 20 <= len(w)) for k in range(len(w))]
        assert rows[i]["n_removed"] == sum(gone) and words(rows[i]["kept"]) == [x for x, g in zip(w, gone) if not g]
    with pytest.raises(ValueError, match="not broadcast"):
        substring_dedup.remove_reference(docs, reference, most_bytes=10)


# --- 6 near duplicates ----------------------------------------------------------------------------------------


def shingled(text, k):
    w = words(fold(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_near(texts, k):
    sets, parent = {i: shingled(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def family(n, size, edits, seed):
    """Copies of one text with some words changed: similarities lie around the threshold."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(size), rng.randint(0, edits)):
            own[k] = "edit" + str(rng.randint(0, 10**6))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("shingle", "rounds", "block", "words"), [(4, 2, 2048, 500_000), (4, 0, 8, 900), (5, 1, 8, 900)])
def test_near_duplicates_against_brute_force(spark, docs, texts, shingle, rounds, block, words):
    more = dict(texts) | {1000 + i: t for i, t in enumerate(family(40, 120, 5, 1) + family(25, 200, 9, 2))}
    df = docs.select("doc_id", "text", "rep", "n").unionByName(spark.createDataFrame([(i, t, 1, 1) for i, t in more.items() if i >= 1000], "doc_id long, text string, rep int, n int"))
    rows = near_dedup.near_duplicates(df, shingle=shingle, rounds=rounds, block=block, block_shingles=words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_near(more, shingle)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_defined_cases(empty, odd):
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in near_dedup.near_duplicates(odd).collect())
    assert rows == [(-1, 0, -1, True), (-1, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


def test_near_duplicates_of_ids_with_an_empty_text(spark):
    a = " ".join(f"w{i}" for i in range(100))
    b = a.replace("w50 ", "other ")
    near = spark.createDataFrame([(1, a), (1, ""), (2, b), (2, None), (3, ""), (4, " ")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(near).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["n_shingles"]) == Counter([(1, 96, 1), (2, 96, 1)])
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] > 2} == {(3, 3, True), (4, 4, True)}
    # sets under the similarity are not linked by the ids' empty ones
    apart = spark.createDataFrame([(1, a), (1, ""), (2, a.replace("w", "v")), (2, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(apart).collect()} == {(1, 1), (2, 2)}


def test_similar_counts_full_sets():
    one, sets = np.arange(100, dtype=np.uint64), [np.arange(20, 100, dtype=np.uint64), np.arange(21, 100, dtype=np.uint64), np.arange(11, 111, dtype=np.uint64), np.zeros(0, np.uint64)]
    assert near_dedup.similar(one, sets, 80).tolist() == [True, False, True, False]
    assert near_dedup.similar(sets[3], sets, 80).tolist() == [False] * 4


def test_a_block_gives_fewer_links_than_members():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.sort(np.concatenate([rng.permutation(base)[n:], rng.integers(0, 1 << 63, n).astype(np.uint64)])) for n in rng.integers(15, 36, 60)]
    pairs = [(a, b) for a in range(60) for b in range(a) if near_dedup.similar(sets[a], [sets[b]], 80)[0]]
    assert 0 < len(pairs) < 1770
    rows = [(0, 0, 0, 0, 0, i, i, near_dedup.signature(s).tobytes()) for i, s in enumerate(sets)]
    found = near_dedup.linked(near_dedup.Block(rows, near_dedup.least_matches(0.8, 1e-6)), sets, 80)

    def groups(edges):
        at = list(range(60))
        for a, b in edges:
            at = [at[a] if x == at[b] else x for x in at]
        return sorted(sorted(i for i in range(60) if at[i] == x) for x in set(at))

    assert len(found) < 60 and groups(found) == groups(pairs)


def test_posterior_bounds():
    least = near_dedup.least_matches(0.8, 1e-6)
    assert least == sorted(least) and all(n < 0.8 * 32 * (i + 1) for i, n in enumerate(least))


# --- 7 fingerprints -------------------------------------------------------------------------------------------


def test_fingerprints_of_texts_and_edits(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    order, errors = sorted(texts), []
    for at, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        cut = len(own) // 4
        edited, r = own[: len(own) - cut] + after[:cut], got[i]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, c in ((edited, "near_edited"), (after, "near_next")):
            a, b = shingled(own, 5), shingled(other, 5)
            errors.append(r[c] - (len(a & b) / len(a | b) if a | b else 1.0))
            if len(a) < fingerprints.K and len(b) < fingerprints.K:
                assert abs(errors[-1]) < 0.1
        assert len(r["sketch"]) == min(fingerprints.K, len(shingled(own, 5))) and r["sketch"] == sorted(r["sketch"])
    assert abs(np.mean(errors)) < 0.03 and len(got) == len(texts)
    same = [tuple(got[i]["sketch"]) for i in (3, 7, 11)]
    assert len(set(same)) == 1


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"w{i}" for i in range(1500)), " ".join(f"w{i}" for i in range(1000, 2600))
    parts = spark.createDataFrame([("x", a), ("x", b), ("y", b), ("z", None), (None, b)], "k string, t string")
    merged = fingerprints.merge(fingerprints.with_sketch(parts, "t", "s"), ["k"], "s")
    whole = fingerprints.with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), "a", "s")
    whole = fingerprints.with_sketch(whole, "b", "o").crossJoin(merged.filter("k = 'x'").select(F.col("s").alias("u")))
    r = whole.select("s", "o", "u", fingerprints.distinct_shingles("u").alias("n"), fingerprints.resemblance("s", "o").alias("j"), fingerprints.containment("s", "u").alias("c")).first()
    assert r["u"] == sorted(set(r["s"]) | set(r["o"]))[: fingerprints.K]
    assert r["n"] == pytest.approx(2592, rel=0.3) and r["j"] == pytest.approx(496 / 2596, abs=0.12) and r["c"] > 0.75
    assert {x["k"]: len(x["s"]) for x in merged.collect()} == {"x": 128, "y": 128, "z": 0, None: 128}


def test_fingerprints_defined_cases(empty, odd):
    assert fingerprints.fingerprints(empty).count() == 0
    assert len(fingerprints.fingerprints(odd).collect()) == 5


@pytest.mark.parametrize("ids", ["many of one id", "many nulls", "plain"])
def test_ranges_keep_the_order_and_cut_hot_ids(spark, ids):
    hot = {"many of one id": 7, "many nulls": None, "plain": 0}[ids]
    rows = [(i if ids == "plain" or i % 3 else hot, f"text {i} {i * i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["tie"], r["bucket"]) for r in fingerprints.with_range(df, 24).collect()), key=lambda r: r[:3])
    assert [r[3] for r in found] == sorted(r[3] for r in found)
    assert len(found) == 900 and max(Counter(r[3] for r in found).values()) < 110
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(df, "doc_id", "text").filter("borrowed = 0").collect()]
    tie = {r["text"]: r["tie"] for r in fingerprints.with_range(df, 24).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))]
    assert {t: n for _, t, n in got} == {t: order[(i + 1) % 900] for i, t in enumerate(order)}


def test_binary_search_of_marks(spark):
    marks = [-5, 0, 0, 3, 3, 3, 9]
    got = spark.range(-7, 12).select("id", fingerprints._below(marks, F.col("id"), True).alias("le"), fingerprints._below(marks, F.col("id"), False).alias("lt")).collect()
    assert all(r["le"] == sum(m <= r["id"] for m in marks) and r["lt"] == sum(m < r["id"] for m in marks) for r in got)


def test_fingerprints_plan_has_no_python(docs):
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 8 quality, 9 language ------------------------------------------------------------------------------------


def test_quality_learns_and_scores_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op8_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    assert docs.count() == queries.op8_quality(spark, "/root/testdata/sf0.01").count()


def test_quality_defined_cases(spark, docs, empty, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["text"]}) == 1
    assert {r["score"] for r in quality.classify(docs, labels.filter("false")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    clash = quality.classify(docs.withColumn("score", F.lit("x")), labels.filter("false"))
    assert clash.columns.count("score") == 1 and dict(clash.dtypes)["score"] == "double"


def test_operators_keep_columns_of_their_own_working_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z", "w")], "doc_id long, text string, _scored string, _read string, c0 string, out string")
    scored = quality.score(docs, quality.Model(np.zeros(1 << quality.BITS), 0.0))
    assert scored.first().asDict() == docs.first().asDict() | {"score": 0.5}
    assert language_id.identify(docs, language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))).first().asDict() == docs.first().asDict() | {"lang_pred": "und", "score": 0.0}


def char_grams(text, n):
    return [g[i : i + n] for w in words(text) for g in [f" {w} "] for i in range(len(g) - n + 1)]


def test_quality_features_are_words_and_their_character_grams():
    texts = ["ab cd  ünïx", None, "字 𝒳yz a", "", "a"]
    data, offsets = common.text_buffers(pa.array(texts))
    for kind, n in zip(quality.features(data, offsets, 40), (0, 3, 4), strict=True):
        buckets, first = kind
        names = {}
        for i, t in enumerate(texts):
            expected = char_grams(t, n) if n else words(t)
            own = buckets[first[i] : first[i + 1]].tolist()
            assert len(own) == len(expected)
            for g, b in zip(expected, own, strict=True):
                assert names.setdefault(g, b) == b
        assert len(set(names.values())) == len(names)


def brute_sgd(texts, labels, dim=8, epochs=6, rate=0.5, seed=5):
    """The same descent, number by number."""
    size, rng = 1 << quality.BITS, np.random.default_rng(seed)
    vectors, layer, bias = rng.uniform(-1, 1, (size, dim)) / dim, (rng.uniform(-1, 1, (dim, 2)) / dim).tolist(), [0.0, 0.0]
    seen, seen_layer, done = [1e-8] * size, 1e-4, 0
    docs = []
    for t in texts:
        data, offsets = common.text_buffers(pa.array([t]))
        own = Counter(int(b) for buckets, _ in quality.features(data, offsets) for b in buckets)
        docs.append({b: c / max(1, sum(own.values())) for b, c in own.items()})
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            pace = rate * (1 - done / (epochs * len(docs)))
            hidden = [sum(w * vectors[b, k] for b, w in docs[i].items()) for k in range(dim)]
            z = [sum(hidden[k] * layer[k][c] for k in range(dim)) + bias[c] for c in (0, 1)]
            p = [math.exp(x - max(z)) for x in z]
            err = [x / sum(p) - (labels[i] == c) for c, x in enumerate(p)]
            back = [sum(layer[k][c] * err[c] for c in (0, 1)) for k in range(dim)]
            seen_layer += sum((hidden[k] * err[c]) ** 2 for k in range(dim) for c in (0, 1))
            for k in range(dim):
                for c in (0, 1):
                    layer[k][c] -= pace * hidden[k] * err[c] / math.sqrt(seen_layer)
            bias = [bias[c] - 0.05 * pace * err[c] for c in (0, 1)]
            for b, w in docs[i].items():
                seen[b] += w * w * sum(x * x for x in back)
                for k in range(dim):
                    vectors[b, k] -= pace * w / math.sqrt(seen[b]) * back[k]
            done += 1
    logit = lambda d: sum(w * sum(vectors[b, k] * (layer[k][1] - layer[k][0]) for k in range(dim)) for b, w in d.items()) + bias[1] - bias[0]
    return [logit(d) for d in docs]


def test_quality_fit_against_plain_python(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS[: 40] if i % 2 else WORDS[25:], k=rng.randint(1, 40))) for i in range(40)] + ["", "Ünï çé"]
    labels = [i % 2 for i in range(42)]
    expected = brute_sgd(texts, labels)
    data, offsets = common.text_buffers(pa.array(texts))
    assert quality.fit(pa.array(texts), np.array(labels)).logits(data, offsets) == pytest.approx(expected, abs=1e-3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    for i, z in enumerate(expected):
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)
    assert quality.train(docs, known, sample_bytes=0).scores.any() == False  # noqa: E712  nothing fits in the bound


def test_quality_score_is_the_softmax_of_the_average():
    data, offsets = common.text_buffers(pa.array(["ab cd", "", "x"]))
    model = quality.Model(np.arange(1 << quality.BITS) / (1 << quality.BITS), -0.25)
    alone = [model.logits(*common.text_buffers(pa.array([t])))[0] for t in ("ab cd", "", "x")]
    assert model.logits(data, offsets) == pytest.approx(alone) and alone[1] == -0.25


def test_language_held_out(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_defined_cases(spark, empty, odd):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("der die das und nicht", "de"), ("the and for with that", "en")] * 5 + [("and the", "en")])] + [(None, None, "en"), (90, "zzz", None)], "doc_id long, text string, lang string")
    filters = language_id.train(train)
    texts = ["und nicht die", "with that for", "12 ... !!", None, "", "qqq", "中文", "with " * 5000]
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("x")), filters).collect()}
    assert [rows[i][0] for i in range(8)] == ["de", "en", "und", "und", "und", "en", "en", "en"] and rows[5][1] == 0.0
    assert language_id.identify(empty, filters).count() == 0 and len(language_id.identify(odd, filters).collect()) == 5
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.train(empty)).collect()} == {"und"}


def test_language_grams_and_decision_against_plain_sets():
    rng = random.Random(8)
    corpora = {lang: ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(60)] for lang, letters in (("aa", "abcdü"), ("bb", "cdefg"), ("cc", "efgh字"))}
    texts = [" ".join(rng.choices(corpora[lang], k=30)) for lang in ("aa", "bb", "cc") for _ in range(8)] + ["", "zzzz", "A"]

    def plain(text):
        raw = [f" {w} ".encode() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", fold(text))]
        return [w[i : i + n] for n in language_id.SIZES for w in raw for i in range(len(w) - n + 1)]

    data, offsets = common.text_buffers(pa.array(texts))
    hashes, first = language_id.grams(data, offsets)
    names = {}
    for i, t in enumerate(texts):
        own = hashes[first[i] : first[i + 1]].tolist()
        assert len(own) == len(plain(t))
        for g, h in zip(plain(t), own, strict=True):
            assert names.setdefault(g, h) == h
    assert len(set(names.values())) == len(names)
    sets = {lang: {g for w in corpus_words for g in plain(w)} for lang, corpus_words in corpora.items()}
    learned = {lang: np.array(sorted(names[g] for g in own if g in names), np.uint64) for lang, own in sets.items()}
    best, score = language_id.Filters.build(learned, dict.fromkeys(learned, 1), probes=4, bits_each=64).decide(hashes, first)
    for i, t in enumerate(texts):
        counts = [sum(g in sets[lang] for g in plain(t)) for lang in sorted(sets)]
        if not any(counts):
            assert best[i] == -1
        else:
            assert counts[best[i]] == max(counts) and score[i] == pytest.approx(max(counts) / len(plain(t)), abs=0.02)


def test_bit_sliced_filters_return_all_languages():
    sets = {f"l{i:02}": np.arange(i * 50, i * 50 + 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(70)}
    filters = language_id.Filters.build(sets, dict.fromkeys(sets, 1))
    probe = (np.array([3000], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
    mask = filters.lookup(np.array([probe]))[0]
    has = {n for i, n in enumerate(filters.names) if mask[i // 64] >> np.uint64(i % 64) & np.uint64(1)}
    assert {n for n, s in sets.items() if probe in s} <= has and filters.table.shape[1] == 2


# --- 10 WARC --------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/é x", "<p>same</p>"), (5, "http://b", "<p>same</p>"), (3, None, "other\r\n\r\nWARC/1.1"), (9, "http://c", None), (8, "http://d", ""), (7, "http://e\nx", "ü" * 100_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("keeper", F.lit(1))


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(pages, least):
    index = warc.write_archives(pages, least=least)
    rows = {r["page_id"]: r for r in warc.read_records(index).collect()}
    best = {}
    for i, _, t in PAGES:
        best[t or ""] = max(i, best.get(t or "", 0))
    for i, _, t in PAGES:
        raw, r = (t or "").encode(), rows[i]
        first = best[t or ""] if len(raw) >= least else i
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), warc.digest(raw), "response" if first == i else "revisit", None if first == i else first)
        assert r["payload"] == (raw if first == i else None)
    assert rows[3]["url"] is None and rows[1]["url"].startswith("http://a/%C3%A9")


def test_warc_reads_selected_ranges_only(pages):
    index = warc.write_archives(pages)
    rows = warc.read_records(index.filter("page_id in (7, 3)"), gap=0, most=10).collect()
    assert sorted(r["page_id"] for r in rows) == [3, 7]
    found = index.collect()
    assert all(r["length"] > 0 for r in found) and len(found) == len(PAGES)


def test_warc_defined_cases(spark, pages):
    assert warc.read_records(warc.write_archives(pages.filter("false"))).count() == 0
    twice = pages.filter("page_id = 5").unionByName(pages.filter("page_id in (1, 5)"))
    kinds = sorted((r["page_id"], r["record_type"]) for r in warc.read_records(warc.write_archives(twice)).collect())
    assert kinds == [(1, "revisit"), (5, "response"), (5, "response")]
    some = [(None, None, None), (-1, "http://x", None), (None, "http://y", "a"), (None, "http://z", "a"), (7, None, "b"), (None, None, "b"), (7, None, "b"), (6, None, "b")]
    index = warc.write_archives(spark.createDataFrame(some, "page_id long, url string, html string"))
    rows = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(index).collect())
    assert rows == Counter([(None, 0, "revisit", -1), (-1, 0, "response", None), (None, 1, "response", None), (None, 1, "response", None), (7, 1, "response", None), (7, 1, "response", None), (6, 1, "revisit", 7), (None, 1, "revisit", 7)])


def test_warc_record_ids_are_unique_and_referred_to(spark, tmp_path):
    import gzip

    rows = [(i % 40, None, f"<p>{i % 13}</p>") for i in range(80)] + [(None, None, "<p>1</p>"), (90, "http://k", "<p>1</p>")] * 2 + [(91, None, "once"), (92, None, "once")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), root=f"file://{tmp_path}/w")
    heads = [r.split("\r\n\r\n")[0] for f in (tmp_path / "w/archives").iterdir() for r in gzip.decompress(f.read_bytes()).decode().split("WARC/1.1\r\n")[1:]]
    ids = [re.search("WARC-Record-ID: (.*)", h)[1].strip() for h in heads]
    refers = [m[1].strip() for h in heads if (m := re.search("WARC-Refers-To: (.*)", h))]
    assert len(ids) == len(set(ids)) == len(rows) and refers and set(refers) <= set(ids)


def test_damaged_record_is_refused():
    raw, _ = warc.make_record(1, "http://a", b"payload", None, None, "1970-01-01T00:00:00Z")
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(raw.replace(b"payload\r\n", b"paYload\r\n"))


# --- pipeline and queries -------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    scratch, counts = common.Scratch(spark, "test-pipeline"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, SF), name)
        counts.append(docs.count())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] > 0.5 * counts[0]
    assert docs.filter("n_chars <> length(text)").count() == 0
    assert near_dedup.near_duplicates(docs).filter("not kept and n_shingles > 20").count() <= 1
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.find(docs, benchmark).count() == 0
    packed = corpus_pipeline.pack_tokens(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_pipeline_on_odd_rows(spark, odd, empty):
    more = lambda df: df.withColumn("score", F.lit("own")).withColumn("predicted", F.lit(7)).withColumn("_ranges", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("c0", F.lit(2.5))
    for docs in (more(odd), more(empty)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF)
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert all((r["score"], r["predicted"], r["_ranges"], r["kept"], r["c0"]) == ("own", 7, 1, "k", 2.5) for r in out.collect())
        packed = corpus_pipeline.pack_tokens(spark, docs, SF)
        assert packed.count() == docs.count()
    assert corpus_pipeline.drop_near_duplicates(spark, odd, SF).count() == 5  # null ids stay, repeated rows of an id too


def test_pipeline_against_brute_force(spark, tmp_path):
    """The whole run on planted documents: each stage's decision is known beforehand."""
    rng = random.Random(17)
    source = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    model = quality.train(spark.createDataFrame(list(source.values()), SCHEMA), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    item = " ".join(f"quiz{rng.choice(WORDS)}{k}" for k in range(30))
    passage = " ".join(f"pass{rng.choice(WORDS)}{k}" for k in range(60))
    good = [r["text"] for i, r in sorted(source.items()) if labels.get(i) == 1 and r["text"] and len(r["text"]) > 200][:12]
    rows = [(i, f"{t} unique{i} words{i * 7} here{i * 13}" + (f" {passage}" if i in (5, 6) else "") + (f" {item}" if i == 8 else "")) for i, t in enumerate(good)]
    rows += [(20, rows[2][1]), (21, rows[3][1] + " more"), (22, None)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {i: t for i, t in rows}
    # 1: what the classifier, fitted on the given labels, accepts
    own = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    data, offsets = common.text_buffers(pa.array([texts[i] for i, _ in rows]))
    kept = {i: texts[i] for (i, _), z in zip(rows, own.logits(data, offsets)) if 1 / (1 + math.exp(-z)) >= 0.7}
    assert kept and len(kept) < len(rows) and model.scores.any()
    # 2: the smallest id of each component; 3: windows of 50 words that start earlier; 4: texts without an item
    kept = {i: t for i, t in kept.items() if brute_near(kept, 5)[i][1] == i}
    kept = {i: " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else kept[i] for i, (w, gone) in brute_dedup(kept, 50).items()}
    symbols = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", fold(t))
    kept = {i: t for i, t in kept.items() if decontamination.edit_distance(np.array([hash(w) for w in symbols(item)]), np.array([hash(w) for w in symbols(t)], int))[0] > 6}
    _, tok = tokenizer()
    expected = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in kept.items()}
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert set(got["doc_id"]) == set(expected)
    for i, part in got.sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(part["ids"]), "<u4").tolist() == expected[i]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_run(spark, name):
    table = "pages" if name.startswith("op10") else "documents"
    rows = queries.queries()[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows.count() >= n if name.startswith("op1_") else rows.count() > 0 if name.startswith("op3_") else rows.count() == n
