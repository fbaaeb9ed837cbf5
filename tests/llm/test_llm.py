"""The training-data operators against brute force on small tables, with the odd cases that their docstrings define."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from quarrygraph.llm import components, decontam, embed_dedup, html_extract, langid, minhash_dedup, mixing, quality, token_count, token_output, toxicity, wordhash
from quarrygraph.llm.queries import EMBEDDING_SQL, queries, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "\n\t ", "a", "a b", "x" * 5000, "a  b　c", "日本 語", "\U0001f389 hi", "<|endoftext|> x", "ABC abc AbC", "don't  I'll", "▁x y", "<s> a </s>", "\x00 a b"]


def docs_of(spark, texts, **extra):
    rows = [(k, t, extra.get("lang", {}).get(k), extra.get("source", {}).get(k), None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_word_hash_matches_words():
    texts = [t.encode() for t in ODD] + ["Foo BAR foo".encode()]
    h, at = wordhash.hash_words(texts)
    seen = {}
    for t, a, b in zip(texts, at[:-1], at[1:]):
        w = words(t.decode())
        assert b - a == len(w)
        for x, y in zip(w, h[a:b].tolist()):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    assert len(wordhash.hash_words([])[0]) == 0


# --- 1 and 10 ------------------------------------------------------------------------------------------------------


def test_dac_round_trip():
    rng = np.random.default_rng(0)
    for n, top, bits in itertools.product((0, 1, 511, 512, 513, 3000), (2, 255, 256, 70_000, 2**32 - 1), (8, 16)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        c, b, r = token_output.dac_encode(ids, bits)
        assert np.array_equal(token_output.dac_decode(n, c, b, bits), ids)
        for p in rng.integers(0, n, 20) if n else []:
            assert token_output.dac_get(int(p), c, b, r, bits) == ids[p]


def test_pieces_give_the_ids_of_whole_texts():
    import pyarrow as pa

    e = token_output.PieceEncoder(tokenizer_file("byte_bpe_50k.json"))
    small = token_output.PieceEncoder(tokenizer_file("byte_bpe_50k.json"), cache=50, group=100)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", ".", "'s", "é", "0", "日", "<|endoftext|>"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    assert e.by_piece
    for a, b, c in zip(e.encode(pa.array(texts)), e.whole(texts), small.encode(pa.array(texts)), strict=True):
        assert np.array_equal(a, b) and np.array_equal(a, c)


def test_columns_are_those_of_each_document():
    rng = np.random.default_rng(3)
    for bits, top in ((8, 200), (8, 60_000), (8, 1 << 24), (16, 1 << 24)):
        docs = [rng.integers(0, top, n).astype(np.uint32) for n in (0, 1, 8, 9, 511, 512, 513, 0, 2000, 0)]
        columns = token_output.dac_columns(np.concatenate(docs), np.cumsum([0, *map(len, docs)]), bits)
        assert list(zip(*(c.to_pylist() for c in columns))) == [token_output.dac_encode(d, bits) for d in docs]
    assert [c.to_pylist() for c in token_output.dac_columns(np.zeros(0, np.uint32), np.zeros(2, np.int64))] == [[[]]] * 3


def test_pieces_led_by_a_space_are_joined_without_a_mark():
    """The mark between two pieces cost the library as much as the pieces themselves."""
    import pyarrow as pa

    e, seen = token_output.PieceEncoder(tokenizer_file("byte_bpe_50k.json")), []
    own = e._run
    e._run = lambda pieces, between: seen.append((pieces, between)) or own(pieces, between)
    texts = ["Ein Wort, ein 'll Wort's 12 ab12!? \u00e9t\u00e9 \U0001f600", "a  b\n c\u00a0 d \n", "x <|endoftext|> y", "", " ", "\u3000z\t q"]
    for a, b in zip(e.encode(pa.array(texts)), e.whole(texts), strict=True):
        assert np.array_equal(a, b)
    assert {" Wort,", " 'll", " \U0001f600"} <= {p for pieces, between in seen if between == "" for p in pieces}
    assert [p for pieces, between in seen if between is None for p in pieces] == [" <|endoftext|>"]
    e.clear()
    e.bytes[:] = 1  # ids that do not add up to the texts' bytes: the mark parts them
    for a, b in zip(e.encode(pa.array(texts)), e.whole(texts), strict=True):
        assert np.array_equal(a, b)


def test_token_output(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = ODD + [None, " ".join(f"word{k % 977}" for k in range(40_000)), "z" * 20_000]
    docs = docs_of(spark, texts).withColumn("part", F.lit("clash")).orderBy(F.desc("doc_id"))
    out = token_output.token_output(docs, tokenizer_file("byte_bpe_50k.json"), path=str(tmp_path / "t")).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(out, texts, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = token_output.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 8").first()
    assert token_output.dac_get(0, files.chunks, files.bitmaps, files.ranks) == lib.encode(ODD[8], add_special_tokens=False).ids[0]
    same = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    assert [r.start for r in token_output.token_output(same, tokenizer_file("byte_bpe_50k.json")).orderBy("start").collect()] == [0, 2, 4]
    assert token_output.token_output(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_token_counts(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = ODD + [None] + ["".join(rng.choice(list("ab e.\n\t▁<é0日") + ["  ", " the", "\U0001f389"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [" ".join(rng.choice(["the", "of", "naïve", "0b1", "日本語", "x" * 40]) for _ in range(30_000)), "y" * 30_000]
    docs = docs_of(spark, texts).withColumns({"n_tokens": F.lit("clash"), "N_BYTES": F.lit(1)})
    out = token_count.token_counts(docs, path, limit=3).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        n = len(lib.encode(t or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((t or "").encode()), n > 3)
    some = docs.limit(9).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.n_tokens for r in token_count.token_counts(some.unionAll(some), path).collect()) == sorted(2 * [r.n_tokens for r in out[:9]])
    assert token_count.token_counts(docs.limit(0), path).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, "c": 100, None: 0})
    assert t["a"] == 200 and t[None] == 0 and abs(sum(t.values()) - 450) < 1e-9 and max(t.values()) <= 200
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_fit_subset_is_exact_where_a_subset_exists():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.choice(np.arange(1, 40), 6, replace=False)
        counts = rng.integers(0, 4, 6)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = int(rng.integers(0, max(sums) + 5))
        take = mixing.fit_subset(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and int((take * lengths).sum()) <= budget
    ones = mixing.fit_subset(np.array([1, 7, 300]), np.array([5000, 4000, 900]), 123_457)
    assert int((ones * np.array([1, 7, 300])).sum()) == 123_457
    assert mixing.fit_subset(np.array([0, 5]), np.array([3, 1]), 5).tolist()[1] == 1


def test_few_very_long_documents_are_fitted():
    """Lengths far above what the program reckons with word by word: in units, never above the budget, near the best sum."""
    lengths, counts = np.array([3_000_000, 3_100_000, 3_300_007, 3_700_001]), np.array([5, 5, 5, 5])
    for budget in (14_000_000, 9_999_999, 40_000_000, 2_999_999):
        best = max(x for n in itertools.product(range(6), repeat=4) if (x := int((lengths * n).sum())) <= budget)
        take = mixing.fit_subset(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert (take <= counts).all() and best - 5_000 <= got <= budget
    assert mixing.fit_subset(np.array([20_000_000]), np.array([3]), 15_000_000).tolist() == [0]
    lengths, counts = np.append(np.arange(1, 500), 2_000_003), np.append(np.full(499, 1000), 4)
    take = mixing.fit_subset(lengths, counts, 60_000_000)
    assert int((take * lengths).sum()) == 60_000_000 and take[:-1].min() > 0


def test_mix(spark):
    docs = sf_docs(spark).select("doc_id", "source", "text").withColumns({c: F.lit("clash") for c in ("SIZE", "part", "copies", "full", "extra", "pick", "n")})
    a = {r.doc_id: r for r in mixing.mix(docs).collect()}
    b = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert {k: r.taken for k, r in a.items()} == b and len(a) == docs.count()
    by = collections.defaultdict(list)
    for r in a.values():
        assert r["size"] == len(words(r.text)) and r.taken in (0, r["size"], 2 * r["size"])
        by[r.source].append(r)
    want = mixing.targets({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        total = sum(r["size"] for r in rs)
        assert abs(rs[0].target - want[s]) < 1e-6 and rs[0].source_size == total
        copies, sums = (int(want[s] // total), {0}) if total else (0, {0})
        for r in rs:
            sums |= {x + r["size"] for x in sums}
        assert sum(r.taken for r in rs) == copies * total + max(x for x in sums if x <= round(want[s] - copies * total))
    # many documents of one length: as many are taken as the counts ask for
    rows = [(k, " ".join(["w"] * n), "s", None, None) for k, n in enumerate([7] * 4000 + [3] * 500)] + [(9000 + k, "x " * 5, None, None, None) for k in range(300)]
    flat = mixing.mix(spark.createDataFrame([(k, t, None, s, None) for k, t, s, *_ in rows], DOCS)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.first("source_size").alias("z")).collect()
    assert {(r.source, r.z) for r in flat} == {("s", 29_500), (None, 1500)} and all(abs(r.t - r.goal) <= 7 for r in flat)
    # equal rows go together
    same = spark.createDataFrame([(1, "a b", None, "s", None)] * 4 + [(k, "a b", None, "s", None) for k in range(2, 9)], DOCS)
    picked = collections.Counter((r.doc_id, r.taken) for r in mixing.mix(same).collect())
    assert sum(picked.values()) == 11 and len({t for i, t in picked if i == 1}) == 1
    odd = docs_of(spark, [None, "", "a b", "a b", "c"], source={2: "s", 3: "s"})
    assert mixing.mix(odd).count() == 5 and mixing.mix(odd.limit(0)).count() == 0


# --- 3 --------------------------------------------------------------------------------------------------------------


def cross_parse(train: str, text: str) -> int:
    """Longest phrases that occur in train, from left to right; a letter that does not occur is one by itself."""
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in train:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("piece", [1, 7, 1024])
def test_automaton_parses_longest_matches(piece, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(2)
    for _ in range(30):
        train = [rng.choice([3, 4, 5]) for _ in range(rng.randint(1, 60))]
        texts = [[rng.choice([3, 4, 5, 6]) if rng.random() < 0.9 else 3 for _ in range(rng.randint(0, 80))] for _ in range(5)] + [[3] * 50, train * 2]
        got = langid.Automaton(np.array(train), 7).phrases([np.array(t, np.int64) for t in texts])
        assert got.tolist() == [cross_parse("".join(map(chr, train)), "".join(map(chr, t))) for t in texts]
    # text that never meets the first parse of its pieces
    train = np.array([3, 4] * 40)
    assert langid.Automaton(train, 7).phrases([np.array([3, 4] * 300)])[0] == cross_parse("".join(map(chr, train)), "\3\4" * 300)


def test_language_predictions_are_those_of_a_plain_parse(spark):
    docs = sf_docs(spark)
    model, rows = langid.Model(langid.training_sample(docs)), docs.select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower())
    trained = {g: "".join(plain(t).strip() + " " for t in ts) for g, ts in langid.training_sample(docs).items()}
    got = {r.doc_id: r.lang_pred for r in langid.language_id(docs).collect()}
    h = model.entropies([r.text for r in rows], model.classes())
    for r, mine in zip(rows, h):
        t = plain(r.text).strip()
        if len(t) > 3000:
            continue
        want = {g: cross_parse(x, t) * np.log2(len(x)) / len(t) for g, x in trained.items()}
        assert np.allclose(mine, [want[g] for g in model.langs]) and got[r.doc_id] == min(model.langs, key=want.get)


def test_a_text_that_repeats_labelled_text_is_parsed_in_pieces(monkeypatch):
    """No phrase need begin where one began before: the states meet, and no text is parsed symbol by symbol."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefg ") for _ in range(3000))
    model = langid.Model({"x": [passage], "y": ["".join(rng.choice("gfe dcba") for _ in range(2000))]})
    texts = [passage * 9, passage[1000:] + passage * 3, "b" + passage[5:2900] * 4]
    got = model.entropies(texts, model.classes())
    monkeypatch.setattr(langid.Automaton, "phrases", lambda self, parts: np.array([self.plain(p) for p in parts]))
    assert np.array_equal(got, model.entropies(texts, model.classes()))
    monkeypatch.undo()
    monkeypatch.setattr(langid.Automaton, "plain", lambda self, text: 1 / 0)
    model.entropies(texts, model.classes())


def test_scripts_of_many_letters_keep_all_of_them(spark):
    rng = random.Random(1)
    word = lambda first, n: "".join(chr(first + rng.randrange(n)) for _ in range(rng.randint(1, 3)))
    # two languages that differ only in rare letters of one script, two of a script of their own
    kinds = {"a": (0x4E00, 600), "b": (0x4E00 + 300, 600), "c": (0xAC00, 400), "d": (0x0430, 32)}
    texts = [(g, " ".join(word(*kinds[g]) for _ in range(60))) for g in kinds for _ in range(60)]
    docs = docs_of(spark, [t for _, t in texts], lang=dict(enumerate(g for g, _ in texts)))
    got = [r for r in langid.language_id(docs).collect() if r.held_out]
    assert len(langid.Model(langid.training_sample(docs)).letters) > 1000
    assert np.mean([r.lang_pred == texts[r.doc_id][0] for r in got]) > 0.97


def test_long_documents_are_learnt_whole_or_not_at_all(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_CHARS", 500)
    texts = ["short words here"] * 5 + ["x " * 5000 + "ending"] + ["long " * 400] * 3
    docs = docs_of(spark, texts, lang={k: "en" if k < 6 else "de" for k in range(9)})
    sample = langid.training_sample(docs)
    assert set(sample["en"]) == {"short words here"} and sample["de"] == ["long " * 400]


def test_language_id(spark):
    got = langid.language_id(sf_docs(spark)).join(sf_docs(spark).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = docs_of(spark, [None, "123 !!", "hello there", ""], lang={2: "en"})
    assert [r.lang_pred for r in langid.language_id(odd).orderBy("doc_id").collect()] == ["und", "und", "en", "und"]
    twice = odd.withColumns({"lang_pred": F.lit("clash"), "t": F.lit(1), "k": F.lit(2), "size": F.lit(3)})
    again = langid.language_id(twice.unionAll(twice).unionAll(twice.withColumn("doc_id", F.lit(None).cast("long"))))
    assert collections.Counter(r.lang_pred for r in again.collect()) == {"und": 9, "en": 3}
    assert langid.language_id(odd.limit(0)).count() == 0 and {r.lang_pred for r in langid.language_id(docs_of(spark, ["abc"])).collect()} == {"und"}


# --- 4 --------------------------------------------------------------------------------------------------------------


def brute_links(vectors, threshold):
    n, vectors = collections.Counter(), dict(enumerate(vectors))
    unit = {}
    for k, (i, v) in vectors.items():
        x = None if i is None or v is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and len(x) and np.isfinite(x).all() and (x @ x) > 0:
            unit[k] = x / np.sqrt(x @ x)
    parent = {i: i for i, _ in vectors.values()}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(unit, 2):
        if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
            n[a] += 1
            n[b] += 1
            x, y = sorted((find(vectors[a][0]), find(vectors[b][0])))
            parent[y] = x
    return sorted((i is not None, i or 0, n[k], find(i) or 0) for k, (i, _) in vectors.items())


def linked_rows(df, **how):
    return sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id or 0) for r in embed_dedup.embedding_links(df, 0.95, **how).collect())


@pytest.mark.parametrize("cell", [embed_dedup.CELL, 40])
def test_embedding_links(spark, cell):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    vectors = [(int(k), (base[k % 12] + rng.normal(size=8) * rng.choice([0, 0.1, 0.4])).tolist()) for k in range(200)]
    vectors += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None]), (304, []), (305, vectors[0][1]), (306, [2 * c for c in vectors[0][1]]), (307, [1.0, 0.0]), (308, [1.0, 0.0])]
    vectors += [(2**60 + 1, vectors[4][1]), (2**60 + 2, [1.0, 0.001]), (None, [1.0, 0.0]), (None, None), (3, vectors[7][1]), (3, vectors[7][1]), (9, (-base[0]).tolist()), (3, (-base[0]).tolist())]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    assert linked_rows(df, cell=cell) == brute_links(vectors, 0.95)
    assert embed_dedup.embedding_links(df.limit(0)).count() == 0


def test_a_row_without_id_changes_no_other(spark):
    vectors = [(None, [1.0, 0.01]), (5, [1.0, 0.0]), (6, [0.0, 1.0]), (2**60 + 1, [0.01, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_links(df, 0.95).collect()}
    assert got == {None: (0, None, True), 5: (0, 5, True), 6: (1, 6, True), 2**60 + 1: (1, 6, False)}


def test_clustered_vectors_visit_few_cells():
    rng = np.random.default_rng(4)
    for groups in (20, 200):
        base = rng.normal(size=(groups, 32))
        x = base[rng.integers(0, groups, 6000)] + rng.normal(size=(6000, 32)) * 0.12
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        row, cell, own = embed_dedup.cells(x, embed_dedup.centres_of(x[:4000], 2 * groups), 0.95, 1.0)
        # visits do not grow with the number of cells
        assert np.array_equal(np.sort(row[own]), np.arange(6000)) and len(row) < 4 * 6000
        # every link's other end visits the cell where one is at home
        a, b = np.nonzero(x[:800] @ x.T >= 0.95)
        home, seen = np.empty(6000, int), set(zip(row.tolist(), cell.tolist()))
        home[row[own]] = cell[own]
        assert len(a) > 800 and all((v, home[u]) in seen and (u, home[v]) in seen for u, v in zip(a.tolist(), b.tolist()))


def test_vectors_are_dealt_by_blocks_however_many_cells_they_visit(spark, monkeypatch):
    """Spread vectors visit most cells; each visit was once a row that held the whole vector."""
    rng, rows = np.random.default_rng(5), []
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(1500, 32)))], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embed_dedup, "cut", lambda df, own=embed_dedup.cut: (out := own(df), rows.append(out.count()))[0])
    assert embed_dedup.embedding_links(df, 0.95, cell=15).count() == 1500
    assert max(rows) <= 1500
    classes = spark.createDataFrame([(k, f"{k * 7919 % 1500:08}".encode(), rng.normal(size=32).astype("<f8").tobytes(), 32, k, 1) for k in range(1500)], "no long, key binary, packed binary, dim int, rep long, copies long")
    dealt, held = embed_dedup.dealt(classes, 0.95, 15, 1.0)
    assert len(held.value[32].centre) == 100 and dealt.count() <= 1500 * embed_dedup.BLOCKS


@pytest.mark.parametrize("block", [64, 300])
def test_links_between_and_within_blocks(spark, monkeypatch, block):
    """One cell of near copies lies in several blocks; others share one; components of eight bytes beside those of four."""
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "TILE", 37)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base[0] + rng.normal(size=(250, 16)) * 0.2, base[rng.integers(0, 60, 350)] + rng.normal(size=(350, 16)) * rng.choice([0.05, 0.2, 0.5], size=(350, 1))])
    x[::2] = x[::2].astype(np.float32)
    vectors = [(int(k), v.tolist()) for k, v in zip(rng.permutation(600), x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert linked_rows(df, cell=25) == brute_links(vectors, 0.95)


def test_embedding_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({EMBEDDING_SQL})").fetchall())
    assert sorted(tuple(r) for r in queries()["op4_embedding_dedup"](spark, SF).select("vec_id", "n_links", "component_id", "kept").collect()) == want


# --- 5 --------------------------------------------------------------------------------------------------------------


def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed, groups=12, size=14):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = f"z{rng.randrange(400)}"
            out.append(" ".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_groups(spark, shingle, monkeypatch):
    long = " ".join(f"w{k * k % 9973}" for k in range(30_000))
    texts = near_texts(shingle) + [None, "", " ", "a b c", "A  b\tC", "a b c d e", long, long + " and more", "x" * 20_000]
    docs = docs_of(spark, texts).withColumn("rep", F.lit("clash"))
    got = [(r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(docs, shingle, 80).orderBy("doc_id").collect()]
    assert got == brute_groups(texts, shingle, 80)
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 5)
    assert [(r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(docs, shingle, 80).orderBy("doc_id").collect()] == got
    assert minhash_dedup.near_groups(docs.limit(0)).count() == 0


def test_near_groups_with_repeated_and_missing_ids(spark):
    texts = near_texts(9, groups=6, size=8)
    rng = random.Random(2)
    rows = [(rng.choice([None, k, k, k // 3, 2**60 + k]), t) for k, t in enumerate(texts)]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()]
    sets = brute_groups([t for _, t in rows], 4, 100)
    parent: dict = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    linked = lambda a, b: (lambda n: n and 100 * n >= 80 * (len(a) + len(b) - n))(len(a & b))
    of = [frozenset(zip(*[words(t)[i:] for i in range(4)])) if len(words(t)) >= 4 else frozenset([tuple(words(t))]) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is not None and rows[b][0] is not None and linked(of[a], of[b]):
            x, y = sorted((find(rows[a][0]), find(rows[b][0])))
            parent[y] = x
    want = [(i, sets[k][0], find(i) if i is not None else None, i is None or find(i) == i) for k, (i, _) in enumerate(rows)]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("changed", [4, 12])
def test_a_large_group_of_near_copies(spark, monkeypatch, changed):
    """Copies that mostly link to each other, and copies of which only some do: blocks, the lead, and what is left over."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 24)
    rng = random.Random(changed)
    base, texts = [f"w{k}" for k in range(220)], []
    for _ in range(260):
        t = list(base)
        for _ in range(rng.randint(0, changed)):
            t[rng.randrange(len(t))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    got = [(r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(docs_of(spark, texts), 5, 80).orderBy("doc_id").collect()]
    assert got == brute_groups(texts, 5, 80)


def test_odd_sketch_estimates():
    rng, errors = np.random.default_rng(0), []
    for j in (0.8, 0.9, 0.95):
        for _ in range(60):
            n = 300
            both = int(2 * n * j / (1 + j))
            pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - both : 2 * n - both])
            k = minhash_dedup.odd_sketches(np.stack([minhash_dedup.minima(a), minhash_dedup.minima(b)])).view(np.uint64)
            errors.append(float(minhash_dedup.estimates(k[0], k[1])) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < minhash_dedup.MARGIN


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)]
    parent = {x: x for p in pairs for x in p}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.component_id for r in components.connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


# --- 6 and 7 --------------------------------------------------------------------------------------------------------


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_quality(spark):
    d = "/root/testdata/sf0.01" if SF.endswith("sf0.001") else SF
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([r["quality"] for r in got], [r.score for r in got]) > 0.9 and all(r.predicted == (r.score >= 0.3) for r in got)
    odd = docs_of(spark, ODD + [None])
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5} and quality.score_quality(odd, labels).count() == len(ODD) + 1
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def plain_statistics(text):
    """The statistics of a text, counted one by one."""
    t = (text or "").encode()
    if not t:
        return [0.0] * len(quality.NAMES)
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)
    w, lines, n = re.findall(rb"[^\x20\x09-\x0D]+", low), t.split(b"\n"), len(t)
    m, count = max(len(w), 1), lambda f: sum(map(f, t))
    a, z, up, high = 97, 122, count(lambda c: 65 <= c <= 90), count(lambda c: c >= 128)
    letters = max(count(lambda c: a <= c <= z) + up + high, 1)
    pairs = list(zip(w[:-1], w[1:]))
    return [
        np.log1p(n), np.log1p(len(w)), n / m, up / letters, count(lambda c: 48 <= c <= 57) / n, count(lambda c: c in b"#$%&*|<>{}[]=~^_\\@+") / n, count(lambda c: c in b".,;:!?'\"()-") / n, high / n, np.log1p(len(lines)), np.log1p(n / len(lines)),
        len(set(w)) / m, len(set(pairs)) / max(len(w) - 1, 1) if pairs else 1.0, max(collections.Counter(w).values()) / m if w else 0, len(set(lines)) / len(lines),
        len(re.findall(rb"[^\w\s.,;:]{2,}(?=\s|$)", t)) / m, t.count(b"!") / m, letters / n, t.count(b".") / m,
    ]


def test_quality_statistics_are_plain_counts():
    texts = [t for t in ODD if t] + ["A b!  c.\n\nA b! C.. ** !!\nend", "x"]
    got = quality.statistics([t.encode() for t in texts])
    assert np.allclose(got, [plain_statistics(t) for t in texts]) and not quality.statistics([b""]).any()


def test_quality_scores_are_those_of_one_plain_fit(spark):
    """Ridge on all rows at once, solved in one piece, with rates pooled over the same bins."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["good", "plain", "words", "here."]) for _ in range(rng.randint(5, 60))) + rng.choice(["", " !!! $$$ 99 ##", " A B C"]) for _ in range(400)] + ["", "   "]
    labels = {k: int("$" not in t) if rng.random() < 0.95 else 1 for k, t in enumerate(texts[:350])}
    docs = docs_of(spark, [*texts, None]).withColumns({"score": F.lit("clash"), "x": F.lit(1), "y": F.lit(2)})
    known = [*labels.items(), (3, 0), (3, 1), (None, 1), (7, None)]
    got = {r.doc_id: r for r in quality.score_quality(docs, spark.createDataFrame(known, "doc_id long, quality int")).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(len(texts) + 1)}
    x = np.array([plain_statistics(t) for t in [*texts, None]])
    rows = [(k, y) for k, y in known if k is not None and y is not None and not held[k]]
    at, y = [k for k, _ in rows], np.array([float(v) for _, v in rows])
    feature = quality.Map(x[at].mean(0), x[at].std(0))
    f = feature(x)
    d = f.shape[1]
    weight = np.linalg.solve(f[at].T @ f[at] + 1e-3 * len(at) * np.eye(d) / d, f[at].T @ y)
    bins = np.clip((f @ weight + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1)
    total, hits = np.bincount(bins[at].astype(int), minlength=quality.BINS), np.bincount(bins[at].astype(int), y, quality.BINS)
    want = quality.isotonic(total, hits)[bins.astype(int)]
    edge = np.abs(bins - np.round(bins)) < 1e-3  # a bin's edge may fall either way
    assert edge.sum() < 10 and all(abs(got[k].score - want[k]) < 0.05 for k in range(len(want)) if not edge[k])
    assert all(got[k].held_out == held[k] and got[k].predicted == (got[k].score >= 0.3) for k in got)
    assert len({got[400].score, got[402].score}) == 1  # empty and null alike


def test_isotonic_rates_do_not_fall():
    rng = np.random.default_rng(0)
    total = rng.integers(0, 9, 50)
    out = quality.isotonic(total, rng.binomial(total, np.linspace(0, 1, 50)))
    assert (np.diff(out) >= 0).all() and 0 < out[0] <= out[-1] < 1


def plain_margin(m, numbers):
    pairs = sum(float(m.v[a] @ m.v[b]) for a, b in itertools.combinations(numbers, 2))
    return m.w0 + sum(float(m.w[a]) for a in numbers) + pairs


def test_machine_learns_a_pair_that_single_terms_miss():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique(np.array([1] * a + [2] * b + rng.integers(10, 40, 5).tolist(), np.int32)))
        y.append(float(a and b))
    m = toxicity.learn(rows, np.array(y, np.float32), np.ones(3000, np.float32))
    number = m.table()
    of = lambda *t: m.scores([number[list(t)]])[0]
    assert of(1, 2) > 0.9 and of(1) < 0.3 and of(2) < 0.3 and of(11) < 0.3
    # scores are those of the plain sum over pairs
    for r in rows[:50]:
        assert abs(m.scores([number[r]])[0] - 1 / (1 + np.exp(-plain_margin(m, number[r])))) < 1e-5
    assert m.scores([]).shape == (0,) and len(toxicity.learn([], np.zeros(0, np.float32), np.zeros(0, np.float32)).places) == 0


def fillers(rng):
    return [f"fill{'abcdefghij'[rng.randrange(10)]}{'abcdefghij'[rng.randrange(10)]}" for _ in range(6)]


def test_a_pure_interaction_is_learnt(spark):
    rng, texts, y = random.Random(5), [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(fillers(rng) + ["left"] * a + ["right"] * b))
        y.append(int(a != b))
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    got = [r for r in toxicity.score_toxicity(docs_of(spark, texts), labels).collect() if r.held_out]
    assert len(got) > 600 and np.mean([r.predicted == y[r.doc_id] for r in got]) >= 0.95


def test_a_term_that_is_neutral_alone_is_learnt_beside_an_insult(spark):
    rng, rows = random.Random(3), []
    for k in range(4000):
        insult, group = k % 10 == 0, k % 5 == 1 or k % 100 == 0
        other = rng.random() < (0.1 if insult else 0.06 if group else 0.12)
        rows.append((k, fillers(rng) + ["insult"] * insult + ["group"] * group + ["vile"] * other, int(other or insult and group)))
    y, has = np.array([y for _, _, y in rows]), np.array(["group" in w for _, w, _ in rows])
    assert abs(y[has].sum() - has.sum() * y.mean()) < 2 * np.sqrt(has.sum() * y.mean() * (1 - y.mean()))
    docs = docs_of(spark, [" ".join(w) for _, w, _ in rows] + ["insult group", "insult", "group", "filla"])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).where("doc_id >= 4000").collect()}
    assert score[4000] > 0.5 and max(score[4001], score[4002], score[4003]) < 0.3


def test_toxicity(spark):
    d = "/root/testdata/sf0.01" if SF.endswith("sf0.001") else SF
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([r.toxic for r in got], [r.score for r in got]) > 0.9 and np.mean([r.predicted for r in got if not r.toxic]) < 0.02
    odd = docs_of(spark, ODD + [None])
    assert toxicity.score_toxicity(odd, labels.limit(0)).where("score = 0.5").count() == len(ODD) + 1 and toxicity.score_toxicity(odd.limit(0), labels).count() == 0
    # repeated and clashing: every row is judged by its own text
    first = docs.orderBy("doc_id").limit(40).withColumns({"held_out": F.lit("x"), "t": F.lit(1)})
    twice = first.unionAll(first).unionAll(first.withColumn("doc_id", F.lit(None).cast("long")))
    scores = collections.Counter(round(r.score, 9) for r in toxicity.score_toxicity(twice, labels).collect())
    assert len(scores) and all(v % 3 == 0 for v in scores.values())
    kept = toxicity.drop_toxic(twice, labels)
    gone = toxicity.score_toxicity(twice, labels).where("predicted = 1").count()
    assert kept.columns == twice.columns and kept.count() == twice.count() - gone
    with pytest.raises(ValueError):
        toxicity.drop_toxic(first.withColumn("Score", F.lit(1)), labels)


# --- 8 --------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert want and got == want


def test_paraphrases_and_odd_leaks(spark):
    rng = random.Random(1)
    item = [f"term{k}" for k in range(40)]
    filler = lambda n: " ".join(f"fill{rng.randrange(999)}" for _ in range(n))
    loose = [w for k, w in enumerate(item) if k % 5] # a fifth of the words left out
    other = list(item)
    rng.shuffle(other)
    texts = [filler(200) + " " + " ".join(loose) + " " + filler(90), " ".join(other) + filler(50), filler(300), None, "", "  ", " ".join(item)]
    docs = docs_of(spark, texts + [filler(80) + " " + " ".join(item[::5]) for _ in range(30)])  # so the words left out are no rare ones
    bench = spark.createDataFrame([(5, " ".join(item)), (6, None), (7, ""), (8, "tiny item")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == {(0, 5), (6, 5)}
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0


def plain_pairs(texts, items):
    """(text, item, share in order, answer share, cosine, length) of every passage and window, written apart from the operator:
    half windows of 32 words, passages of 48 at most, the rarest third of a passage as answer terms (ties by word hash)."""
    split = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    cut = []
    for i, t in items:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        k = -(-len(w) // 48)
        cut += [(i, w[round(j * len(w) / k) : round((j + 1) * len(w) / k)]) for j in range(k)]
    vocabulary = sorted({x for _, w in cut for x in w}, key=lambda x: int(wordhash.hash_words([x.encode()], wordhash.NON_WORD)[0][0]))
    place = {x: k for k, x in enumerate(vocabulary)}
    df = collections.Counter(x for w in split for x in set(w))
    idf = np.array([max(np.log((len(texts) + 1) / (df[x] + 1)), 0.05) for x in vocabulary])
    rarest = lambda w: sorted(set(w), key=lambda x: (-idf[place[x]], place[x]))[: max(1, len(set(w)) // 3)]
    answers = [set(rarest(w)) for _, w in cut]
    for x in set().union(*answers):
        idf[place[x]] = max(idf[place[x]], np.log(2) + 0.2)
    vector = lambda w: np.bincount([place[x] for x in w if x in place], minlength=len(idf))[: len(idf)] * idf
    matrix = np.stack([vector(w) for _, w in cut])
    _, _, v = np.linalg.svd(matrix / np.linalg.norm(matrix, axis=1, keepdims=True), full_matrices=False)
    basis = v[: max(192, math.ceil(6 * len(cut) ** 0.5))].T
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    quiet = lambda w: [x for x in w if x in place and idf[place[x]] > np.log(2)]
    latent = unit(np.stack([vector(quiet(w)) for _, w in cut]) @ basis)

    def in_order(a, p):
        row = [0] * (len(p) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(p):
                now = row[j + 1]
                row[j + 1] = last + 1 if x == y else max(now, row[j])
                last = now
        return row[-1]

    out = []
    for d, w in enumerate(split):
        for b in range(0, len(w), 32):
            cosine = latent @ unit(vector(quiet(w[b : b + 64])) @ basis)
            around = w[max(0, b - 24) : b + 88]
            have = set(around)
            for k, (i, p) in enumerate(cut):
                told = len(answers[k] & have) / len(answers[k])
                if told >= 0.4:
                    out.append((d, i, in_order(around, p) / len(p), told, float(cosine[k]), len(p)))
    return out


def reworded(rng, items, words_, share):
    """Each item with a share of its words exchanged and its first part moved to the end, among other words."""
    draw = lambda n: [words_[int(len(words_) * rng.random() ** 2)] for _ in range(n)]
    texts = []
    for item in items:
        said = [w if rng.random() > share else draw(1)[0] for w in item]
        k = int(rng.uniform(0.3, 0.4) * len(said))
        texts.append(" ".join(draw(int(rng.integers(0, 60))) + said[k:] + said[:k] + draw(int(rng.integers(0, 60)))))
    return texts


def test_each_route_of_leaks_against_plain_search(spark, monkeypatch):
    """1,000 items: copies with words left out, and reworded ones with moved clauses. The latent route alone, the verbatim route
    alone, and both; without an SVD the latent route finds nothing."""
    rng = np.random.default_rng(6)
    words_ = [f"word{k}" for k in range(3000)]
    draw = lambda n: [words_[int(3000 * rng.random() ** 2)] for _ in range(n)]
    items = [draw(int(rng.integers(12, 60))) for _ in range(1000)]
    texts = reworded(rng, items[:500], words_, 0.2)
    texts += [" ".join(draw(int(rng.integers(0, 50))) + [w for w in item if rng.random() > 0.15] + draw(20)) for item in items[500:]]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    docs, rules = docs_of(spark, texts), decontam.Rules()
    pairs = plain_pairs(texts, list(enumerate(map(" ".join, items))))
    latent = {(d, i) for d, i, share, told, cosine, _ in pairs if cosine >= rules.cosine and share >= rules.near_cover and told >= rules.near_answer}
    verbatim = {(d, i) for d, i, share, told, _, _ in pairs if share >= rules.cover and told >= rules.answer}
    found = lambda r: {(x.doc_id, x.item_id) for x in decontam.find_leaks(docs, bench, r).collect()}
    assert found(rules._replace(cosine=9.0)) == verbatim
    by_cosine, both = found(rules._replace(answer=9.0)), found(rules)
    assert len(by_cosine & latent) >= 0.97 * len(latent) and len(by_cosine - latent) <= 0.03 * len(latent)
    assert both == by_cosine | verbatim
    assert sum((k, k) in both for k in range(500)) >= 0.9 * 500 and sum((k, k) in verbatim for k in range(500)) <= 0.8 * 500
    assert sum((k, k) in both for k in range(500, 1000)) >= 0.98 * 500 and len(both) <= 1.02 * 1000
    monkeypatch.setattr(decontam, "latent_basis", lambda rows, idf, rank: np.zeros((len(idf), 4)))
    assert found(rules._replace(answer=9.0)) == set() and found(rules) == verbatim != both


def test_short_items_must_stand_word_for_word(spark):
    gap = " ".join(f"fill{k}" for k in range(25))
    texts = [f"alpha {gap} beta {gap} gamma", f"{gap} alpha beta gamma {gap}", "alpha beta", "alpha, Beta: GAMMA!", f"alpha beta {gap} beta gamma"]
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, "gamma alpha")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs_of(spark, texts), bench).collect()}
    assert got == {(1, 1), (3, 1)} | {(k, 2) for k in range(5)}


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    clash = docs.withColumns({"item_id": F.lit("x"), "covered": F.lit(1)}).unionAll(docs.withColumns({"doc_id": F.lit(None).cast("long"), "item_id": F.lit("x"), "covered": F.lit(1)}).limit(20))
    rows = lambda: sorted((r.doc_id is not None, r.doc_id or 0, r.item_id, r.covered) for r in decontam.find_leaks(clash, bench).collect())
    whole = rows()
    kept = decontam.drop_leaks(clash, bench)
    assert kept.columns == clash.columns and kept.count() == clash.count() - len({(r.doc_id, r.text) for r in clash.join(decontam.find_leaks(docs, bench).select("doc_id").distinct(), "doc_id", "left_semi").collect()}) - sum(not r[0] for r in whole)
    monkeypatch.setattr(decontam, "BENCHMARK", 1_000)
    assert len(decontam.blocks(bench)) > 1 and rows() == whole


def test_paraphrases_are_found(spark):
    """Words left out, put in and exchanged at random: what keeps the rules' share of words and answer terms is found."""
    rng = np.random.default_rng(11)
    words_ = [f"word{k}" for k in range(4000)]
    draw = lambda n: [words_[int(4000 * rng.random() ** 3)] for _ in range(n)]
    items, texts = [draw(int(rng.integers(15, 60))) for _ in range(300)], []
    for item in items:
        said = [w if rng.random() > 0.15 else draw(1)[0] for w in item if rng.random() > 0.1]
        texts.append(" ".join(draw(int(rng.integers(0, 200))) + [x for w in said for x in ([w] if rng.random() > 0.1 else [w, draw(1)[0]])] + draw(int(rng.integers(0, 200)))))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs_of(spark, texts), bench).collect()}
    assert sum((k, k) in got for k in range(300)) >= 0.95 * 300 and len(got) <= 305


def test_common_length():
    rng = random.Random(0)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(30)], [rng.randrange(6) for _ in range(12)]
        t = np.zeros((31, 13), int)
        for i, j in itertools.product(range(30), range(12)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        masks: dict[int, int] = {}
        for k, x in enumerate(b):
            masks[x] = masks.get(x, 0) | 1 << k
        assert decontam.common_length(np.array(a), masks, 12) == t[30, 12]


# --- 9 --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="page">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more cookies, on this page, always.</p></div>
<div id="wrap"><div class="content"><h1>The &amp; title</h1><p>First  paragraph,\n with text, and commas, and more words to be long enough.<p>Second &lt;one&gt; is here, with <a href="x">a link</a> and a <b>bold</b> word.
<div class="advert">Buy now, cheap, good, fine.</div><ul><li>An item of the list, long enough<li>Another item</ul><form><p>Your name, please, here</p><input></form></div>
<aside><p>Related, things, to, read, in, the, sidebar, today.</p></aside></div>
<section id="comments"><p>I, a reader, think, this is, great, thanks.</p></section><!-- no --><footer><p>Copyright, all rights, reserved.</p></footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "The & title\nFirst paragraph, with text, and commas, and more words to be long enough.\nSecond <one> is here, with a link and a bold word.\nAn item of the list, long enough\nAnother item"
    for t in (None, "", "<", "<p", "</p></div>", "<!--", "<script>x", "plain text", "<" * 2000, "<div>" * 3000 + "deep, text"):
        html_extract.main_text(t)
    assert html_extract.main_text("plain &eacute; text") == "plain é text"
    wrapped = '<body><div class="no-sidebar"><div class="post"><h1>T</h1><p>A text, long, with commas.</p></div><div class="widget">Links</div></div></body>'
    assert html_extract.main_text(wrapped) == "T\nA text, long, with commas."
    assert html_extract.main_text("<body><nav>Menu</nav><script>x</script></body>") == ""


def test_articles_are_containers_among_others():
    story = "".join(f"<p>Paragraph {k} of the story, long enough, with commas, to be prose.</p>" for k in range(6))
    teaser = '<article><h3>Next</h3><p>Read this, too.</p></article>'
    told = [f"Paragraph {k} of the story, long enough, with commas, to be prose." for k in range(6)]
    for page in (f'<body><div class="page"><div class="content">{story}</div></div><div class="more">{teaser}</div></body>', f'<body><div class="content">{story}</div><div><div>{teaser}{teaser}</div></div></body>'):
        assert html_extract.main_text(page).split("\n") == told
    prose = "A first paragraph of the page itself, outside of the article, and long enough to be prose, as it says."
    assert html_extract.main_text(f"<body><main><p>{prose}</p><article>{story}</article></main></body>").split("\n") == [prose, *told]
    assert html_extract.main_text(f"<body><main><article>{teaser}</article><div>{story}</div></main></body>").split("\n")[-6:] == told


STORY = [f"Paragraph {k} of the story, long enough, with commas, to be prose." for k in range(6)]


@pytest.mark.parametrize("comments", [1, 4, 12, 40, 200])
def test_comments_are_never_the_story(comments):
    """However many there are, in the markup of common blog software, beside the story or inside its article."""
    story = "".join(f"<p>{t}</p>" for t in STORY)
    said = "".join(f"<p>Comment {k}, a reader's view, at some length, with commas, as long as the story's own.</p>" for k in range(3))
    shapes = (
        f'<ol class="commentlist">{f"""<li class="comment even depth-1"><article class="comment-body">{said}</article></li>""" * comments}</ol>',
        f'<div id="comments" class="comments-area"><h2>Comments</h2>{f"<article>{said}</article>" * comments}</div>',
        f'<div class="related-posts">{f"<article><h3>Next</h3>{said}</article>" * comments}</div>',
        f'<section class="comment-list">{f"""<div class="reply">{said}</div>""" * comments}</section>',
    )
    for more in shapes:
        for page in (f"<main><article>{story}</article>{more}</main>", f'<div class="post">{story}</div>{more}', f"<main><article>{story}{more}</article></main>", f'<div class="page"><div>{story}</div><div>{more}</div></div>'):
            assert html_extract.main_text(f"<html><body>{page}</body></html>").split("\n") == STORY


def test_names_inside_the_article():
    story = "".join(f"<p>{t}</p>" for t in STORY)
    heads = ("related-work", "search", "navigation", "alerts", "comments", "sharing", "menu")
    inner = "".join(f'<h{2 + k % 5} id="{x}">About {x}</h{2 + k % 5}>' for k, x in enumerate(heads))
    assert html_extract.main_text(f"<body><article>{story}{inner}</article></body>").split("\n") == STORY + [f"About {x}" for x in heads]
    cost = "Costs, of search, over time, as they were measured, and what they were made of."
    for name in ('id="search-cost"', 'id="related-work"', 'class="nav-history"', 'id="sharing-economy"'):
        assert html_extract.main_text(f"<body><article>{story}<section {name}><p>{cost}</p></section></article></body>").split("\n") == [*STORY, cost]
        assert html_extract.main_text(f'<body><article>{story}<div {name}><a href="x">{cost}</a></div></article></body>').split("\n") == STORY
    for name in ('class="sidebar"', 'class="widget-area"', 'role="complementary"'):  # teasers in a sidebar make it no wrapper of the article
        assert html_extract.main_text(f"<body><div {name}><article><h3>Next</h3><p>{cost}</p></article></div><article>{story}</article></body>").split("\n") == STORY
        assert html_extract.main_text(f"<body><div {name}><article>{story}</article></div></body>").split("\n") == STORY
    assert html_extract.main_text("<p>&<b>amp;</b> &am<i>p;</i> &amp;amp; x</p>") == "&amp; &amp; &amp; x"


def random_page(rng):
    tags = ["div", "p", "section", "article", "ul", "li", "span", "a", "b", "blockquote", "td", "h2"]
    return "".join(rng.choice([f"<{rng.choice(tags)}>", f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "some words, and more ", "x &amp; y ", "<br>"]) for _ in range(rng.randint(0, 60)))


def test_scores_are_those_of_a_plain_climb():
    rng = random.Random(8)
    for _ in range(300):
        root = html_extract.parse(random_page(rng))
        order = html_extract.elements(root)
        html_extract.settle(order)
        html_extract.measure(order)
        score = dict.fromkeys(order, 0.0)

        def inline(n):
            """Text of n that is in no block further in, and its commas: white space is gathered within each element."""
            own = re.sub(r"\s+", " ", "".join(k for k in n.kids if isinstance(k, str)).replace("&amp;", "&")).strip()
            inner = [inline(k) for k in n.kids if not isinstance(k, str) and k.tag not in html_extract.BLOCK]
            return len(own) + sum(a for a, _ in inner), own.count(",") + sum(b for _, b in inner)

        for n in order:
            chars, commas = inline(n)
            if n.tag in html_extract.BLOCK and chars:
                up, points = n.parent if n.tag in html_extract.GIVES else n, 1 + commas + min(chars / 100, 30)
                while up is not None:
                    score[up] += points
                    up, points = up.parent, points / 2
        assert all(abs(n.score - score[n]) < 1e-9 for n in order)


def test_odd_pages_take_linear_time():
    import time

    n = 100_000
    for page in ('<div class="menu">' * n, "<div>" * n + "</span>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<div><p>a, b</p>" * n, "<table>" + "<tr><td>x" * n, "<span>a,<div>b" * n, "<ul><li>" * n, "<p>" + "long, text. " * n):
        t = time.time()
        html_extract.main_text(page)
        assert time.time() - t < 20  # a quadratic step would take minutes


def test_nothing_else_is_dropped():
    story = "".join(f"<p>Paragraph {k} of the story, long enough, with commas, to be prose.</p>" for k in range(3))
    for kept in ("<p hidden>Kept, this.</p>", '<p style="display:none">Kept, this.</p>', '<p aria-hidden="true">Kept, this.</p>', "<p><label>Kept, this.</label></p>", "<fieldset>Kept, this.</fieldset>", "<p><math>Kept, this.</math></p>", "<p><object>Kept, this.</object></p>", "<dialog>Kept, this.</dialog>"):
        assert html_extract.main_text(f"<body><div>{story}{kept}</div></body>").split("\n")[-1] == "Kept, this."
    for gone in ('<div role="search">Gone</div>', "<aside>Gone</aside>", '<div class="cookie-bar">Gone</div>', '<p><button>Gone</button></p>', '<ul class="comment-list"><li>Gone</li></ul>'):
        assert "Gone" not in html_extract.main_text(f"<body><div>{story}{gone}</div></body>")


def test_extract(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = html_extract.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(out) == pages.count() and all(r.n_chars == len(r.text) and r.text for r in out)
    assert html_extract.extract(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, None)], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_extract.extract(odd).collect()] == [("", 0)] * 2


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    docs = sf_docs(spark)
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    rows = kept.orderBy("doc_id").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - bad and kept.columns == corpus_pipeline.COLUMNS
    near = brute_groups([r.text for r in rows], 5, 80)
    want = {rows[k].doc_id for k, (_, c) in enumerate(near) if c == k}
    kept = corpus_pipeline.drop_near_duplicates(spark, kept, SF)
    assert {r.doc_id for r in kept.collect()} == want
    leaks = {r.doc_id for r in decontam.find_leaks(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = corpus_pipeline.drop_benchmark_leaks(spark, kept, SF)
    assert {r.doc_id for r in kept.collect()} == want - leaks
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(kept).collect() if r["size"]}
    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, kept, SF).collect())
    assert mixed == collections.Counter({k: v for k, v in times.items() if v})
    out = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in out) == mixed
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_pipeline_stages_on_odd_rows(spark):
    docs = sf_docs(spark).limit(60)
    odd = docs.withColumn("doc_id", F.lit(None).cast("long")).limit(10).unionAll(docs_of(spark, [None, "", " "]).withColumn("doc_id", F.col("doc_id") + 10**6))
    every = docs.unionAll(odd).unionAll(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, every, SF)
        assert got.columns == corpus_pipeline.COLUMNS and stage(spark, every.limit(0), SF).count() == 0, name
        assert got.where("doc_id >= 1000000").count() == 3, name
    assert corpus_pipeline.write_token_ids(spark, every, SF).count() == every.count() and corpus_pipeline.write_token_ids(spark, every.limit(0), SF).count() == 0
    # a row without doc_id that is toxic or a leak goes like any other
    bad = decontam.find_leaks(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), spark.read.parquet(f"{SF}/benchmark.parquet")).count()
    same = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.drop_benchmark_leaks(spark, same, SF).count() == docs.count() - bad


def test_pipeline_decontamination_matches_brute_force(spark):
    docs = sf_docs(spark)
    rows = docs.orderBy("doc_id").collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rules = decontam.Rules()
    bad = {
        rows[d].doc_id for d, _, share, told, cosine, n in plain_pairs([r.text for r in rows], bench)
        if n >= 8 and (share >= rules.cover and told >= rules.answer or cosine >= rules.cosine and share >= rules.near_cover and told >= rules.near_answer)
    }
    kept = {r.doc_id for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, SF).collect()}
    assert bad and kept == {r.doc_id for r in rows} - bad
