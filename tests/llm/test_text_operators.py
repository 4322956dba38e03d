import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomwell.llm import bpe, fingerprints, jaccard_join, langid, licenses, text, token_files

MIT = " ".join(licenses.TEMPLATES["MIT"][-1].removeprefix("MIT License").split())
ODD = ["", " ", "é😀 ß\n\n  x", "don't 'S  12٣  中文", "\x1c\x85\xa0 a\x00b", "x" * 5000, "a " * 3000, "!!??--", "Σς ſK <|endoftext|> İ"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def test_shingle_hashes_tell_shingles_apart():
    texts = [*ODD, "a b c d e f", "A B c d e f", "b a c d e f", "a b", "ab"]
    values, offs = text.shingle_hashes(pa.array(texts))
    known = {}
    for i, t in enumerate(texts):
        own = values[offs[i] : offs[i + 1]].tolist()
        assert len(own) == len(shingles(t))
        for h, s in zip(own, shingles(t)):
            assert known.setdefault(h, s) == s
    assert len(known) == len(set(known.values()))


def test_fingerprints_estimate_generalised_jaccard():
    rng = np.random.default_rng(1)
    gaps = []
    for _ in range(200):
        a, b = rng.integers(0, 12, 60), rng.integers(0, 12, 60)
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        out = np.zeros((2, fingerprints.SAMPLES), np.uint16)
        fingerprints._fill(out, [fingerprints._counted(np.repeat(base, a)), fingerprints._counted(np.repeat(base, b))])
        gaps.append((out[0] == out[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.09


def test_fingerprints_against_edits(spark, docs, empty):
    one = docs.dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in one.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.against_edits(one.withColumn("kind", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)]
        e = fingerprints.edited(t, after[1])
        assert e == t[: len(t) - len(t) // 2] + after[1][: len(t) // 2]
        assert got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[d].n_chars == len(t)
        assert 0 <= got[d].near_edited <= 1
        x, y = (np.frombuffer(bytes.fromhex(got[k].fingerprint), np.uint16) for k in (d, after[0]))
        assert got[d].near_next == (x == y).mean()
    assert fingerprints.against_edits(empty).count() == 0
    assert fingerprints.against_edits(docs).count() == docs.count()
    assert fingerprints.fingerprint(docs).select("text", "fingerprint").distinct().groupBy("text").count().where("count > 1").count() == 0


def test_bpe_is_tiktoken(spark, docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = spark.createDataFrame([(i, t) for i, t in enumerate(ODD, 1000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    got = {r.doc_id: r for r in bpe.digests(both, path, P.PATTERN).collect()}
    for r in both.collect():
        t = r.text or ""
        ids = np.array(enc.encode_ordinary(t), "<u4")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("clash")), path, P.PATTERN), path, P.PATTERN)
    assert back.where("cast(decoded AS string) <> coalesce(text, '')").count() == 0 and back.columns == [*docs.columns, "ids", "decoded"]
    assert bpe.digests(empty, path, P.PATTERN).count() == 0


def test_bpe_model_needs_all_ranks(tmp_path):
    (tmp_path / "x").write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "x"))


def brute_components(rows):
    sets = [set(shingles(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_jaccard_join_is_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in jaccard_join.join(docs.withColumn("token", F.lit(1)).withColumn("n", F.lit(2))).collect())
    assert got == brute_components(rows)
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_join_of_repeated_ids_and_very_long_texts(spark):
    rng = random.Random(13)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(60_000))
    rows = [(1, "a b c d e f g"), (1, "x y z u v w"), (2, "x y z u v w"), (1, "a b c d e f g"), (5, long), (4, long + " end"), (3, long[: len(long) // 2]), (7, None), (7, "")]
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)
    nameless = spark.createDataFrame([(None, "a b c d e f g"), (9, "a b c d e f g"), (None, "q r s t u")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.join(nameless).collect()) == [(0, 0), (0, 9), (9, 9)]


def test_jaccard_join_across_thresholds(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i] + [f"x{i}-{j}" for j in range(i)])) for i in range(0, 14)] + [(50 + i, " ".join(base[i:])) for i in range(14)]
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_jaccard_join_with_long_lists_in_lots(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG", 1)
    monkeypatch.setattr(jaccard_join, "LOT", 5)
    base = [f"w{i}" for i in range(130)]
    near = [(500 + i, " ".join(base[: 100 + i] + [f"y{i}-{j}" for j in range(i % 7)])) for i in range(30)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    got = sorted(tuple(r) for r in jaccard_join.join(both).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in both.collect()])


def test_set_relations_skip_blocks_and_derive_answers(spark, docs):
    base = [f"w{i}" for i in range(150)]
    rng = np.random.default_rng(11)
    rows = []
    for i in range(150):
        w = [x for k, x in enumerate(base) if k < 100 + i % 40]
        for j in rng.integers(0, len(w), i % 6):
            w[j] = f"z{i % 3}-{j}"
        rows.append((i, " ".join(w)))
    counts = {}
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), counts).collect())
    assert got == brute_components(rows)
    assert counts["skipped"] > 0 and counts["through_similar"] > 0 and counts["compared"] < 150 * 149 / 4


def test_answers_follow_from_those_of_hubs(spark):
    rng = np.random.default_rng(12)
    shared = [f"w{i}" for i in range(60)]
    rows = []
    for group in range(4):  # near copies in a group, a passage that all groups share, in too few documents to be passed over as frequent
        own = [f"g{group}-{i}" for i in range(100)]
        for i in range(4):
            w = own[:]
            for j in rng.integers(0, 100, min(i, 1)):
                w[j] = f"z{group}-{i}"
            rows.append((group * 10 + i, " ".join(shared + w)))
    rows += [(90, " ".join(shared)), (91, " ".join(shared[:59])), (92, " ".join(shared + ["end"] * 9))]
    counts = {}
    got = sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), counts).collect())
    assert got == brute_components(rows)
    assert counts["of_hubs"] >= counts["derived"] > 0, counts


def test_bounds_of_bitmaps_are_below_distances(spark):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 40, 63, 64, 65, 120, 129, 300, 301)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 62, 1 + len(s) // 12).astype(np.uint64)])) for s in sets]
    classes = spark.createDataFrame([(i, len(s), [int(x) for x in jaccard_join._parity(s)]) for i, s in enumerate(sets)], "rep long, n int, bits array<long>")
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    told = {(r.a, r.b): r for r in jaccard_join._bounded(spark.createDataFrame(pairs, "a long, b long"), classes).collect()}
    assert len(told) == len(pairs)
    for a, b in pairs:
        both = len(np.intersect1d(sets[a], sets[b]))
        d = 1 - both / (len(sets[a]) + len(sets[b]) - both)
        assert told[a, b].least <= d + 1e-12 and (told[a, b].may or d > 0.2)


def test_questions_go_to_hubs(spark):
    compared = spark.createDataFrame([(1, 2, 0.05, True), (2, 3, 0.1, True), (1, 4, 0.15, True), (5, 6, 0.02, True)], "a long, b long, d double, linked boolean")
    hubs = jaccard_join._hubs(compared)
    assert sorted(map(tuple, hubs.collect())) == [(2, 1, 0.05), (3, 2, 0.1), (6, 5, 0.02)]
    asked = jaccard_join._through_hubs(spark.createDataFrame([(2, 6), (1, 5), (4, 6), (3, 4)], "a long, b long"), hubs).collect()
    assert {(r.a, r.b): (r.one, r.two, round(r.slack, 9)) for r in asked} == {(2, 6): (1, 5, 0.07), (1, 5): (1, 5, 0.0), (4, 6): (4, 5, 0.02), (3, 4): (2, 4, 0.1)}


def test_derived_distances(spark):
    compared = spark.createDataFrame([(1, 2, 0.05, True), (2, 3, 0.1, True), (2, 4, 0.5, False)], "a long, b long, d double, linked boolean")
    pairs = spark.createDataFrame([(1, 3), (1, 4), (1, 9), (3, 4)], "a long, b long")
    assert {(r.a, r.b): r.linked for r in jaccard_join._derived(pairs, compared).collect()} == {(1, 3): True, (1, 4): False, (1, 9): None, (3, 4): False}


def test_components_are_those_of_union_find(spark):
    rng = np.random.default_rng(4)
    chains = [rng.permutation(n) + 1000 * k for k, n in enumerate((2, 3, 9, 40, 150), 1)]
    for links in ([(4, 1), (4, 3), (5, 3), (5, 2)], [(int(a), int(b)) for c in chains for a, b in zip(c, c[1:])]):
        root = {x: x for link in links for x in link}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = jaccard_join.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)


def test_groups_with_more_links_are_those_of_all_links(spark, monkeypatch):
    rng = np.random.default_rng(14)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2)) if a != b]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    groups = jaccard_join.components(frame(links[:90]))
    got = jaccard_join._regrouped(groups, frame(links[90:])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, jaccard_join.components(frame(links)).collect()))
    # Links within groups, or none at all, start no round.
    monkeypatch.setattr(jaccard_join, "components", None)
    assert jaccard_join._regrouped(groups, frame(links[:20])) is groups and jaccard_join._regrouped(groups, frame([])) is groups


def test_one_of_each_group_stays(docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    clash = docs.select("doc_id", "text").unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(3)).withColumns({"_first": F.lit(2), "root": F.lit("own")})
    kept = jaccard_join.keep_one(clash)
    assert kept.columns == clash.columns and kept.where("_first <> 2 OR root <> 'own'").count() == 0
    assert kept.where("doc_id IS NULL").count() == 3 and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want)


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    more = spark.createDataFrame([(i, x) for i, x in enumerate(ODD, 1000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    at, want = 0, []
    for d, x in sorted((r.doc_id, r.text or "") for r in both.collect()):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.round_trip(both, path).collect()) == want
    assert token_files.round_trip(empty, path).count() == 0


def test_token_encoder_is_the_library():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(8)
    library, own = Tokenizer.from_file(path), token_files.Encoder(path)
    plain = list("abcdeXYZ    \n\t.,!?;:''0123<|>-_éÉßµªºÀÿñ½²")
    odd = plain + list("İıŞşΣσςЖжбя中文ﬁǅ\u0327\u0301\u0308\u0307\u1100\u1161\u200d\u2028😀\x85\xa0\x1c") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(rng.choice((plain, odd))) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["İ,", "<|endoftext|>", "a<|endoftext|>B", "Σς ΣΑΣ. ſK", *ODD]
    for at in range(0, len(texts), 256):
        got = [np.frombuffer(x, own.type).tolist() for x in own.encode_all(texts[at : at + 256])]
        assert got == [e.ids for e in library.encode_batch(texts[at : at + 256], add_special_tokens=False)]


def test_token_files_with_nulls_and_clashing_columns(spark):
    path = P.path("word_bpe_49k.json")
    rows = [(None, "b c", 1), (None, "a", 2), (None, "a", 2), (3, None, 3), (1, "<|endoftext|>", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").withColumn("n_tokens", F.lit("clash"))
    got = [tuple(r)[:3] for r in sorted(token_files.round_trip(df, path).collect(), key=lambda r: r.start)]
    assert [g[0] for g in got] == [None, None, None, 1, 3] and [g[1] for g in got] == list(np.cumsum([0, *(g[2] for g in got[:-1])]))
    assert sorted(g[2] for g in got[:3]) == [2, 2, 3] and got[3][2] == 2 and got[4][2] == 1


def test_token_file_layout(tmp_path):
    dtype = np.dtype("<u2")
    with open(tmp_path / "f.arrow", "wb") as out:
        w = token_files._Writer(out, 8, dtype)
        for i in range(1000):
            w.add(np.full(7, i, dtype).tobytes())
        w.close()
    reader = token_files.open_sequences(pa.fs.LocalFileSystem(), str(tmp_path / "f.arrow"))
    table = reader.read_all()
    assert str(table.schema.field("ids").type).startswith("fixed_size_list") and table.num_rows == 875
    assert sum(sum(m.as_py()) for m in table.column("mask")) == 7000
    assert token_files.flat_ids(reader, 7 * 600, 7, 8).tolist() == [600] * 7
    big = token_files.open_sequences(pa.fs.LocalFileSystem(), str(tmp_path / "f.arrow"))
    assert big.num_record_batches == 2


def test_language_id(spark, docs, empty):
    en, de = "the cat and the dog are in the house with others ", "der hund und die katze sind nicht im haus mit dem "
    rows = [(i, (en if i % 2 else de) * (1 + i % 3) + str(i), "en" if i % 2 else "de") for i in range(80)] + [(100, None, "en"), (101, "123 !!", "de"), (102, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.report(df).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(80))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(80))
    assert langid.report(empty).count() == 0
    assert {r.lang_pred for r in langid.report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_a_text_depends_on_it_alone(spark):
    rng = np.random.default_rng(1)
    code = langid.codewords(4)
    model = langid.Model(tuple("abcd"), code, (rng.normal(size=(langid.DIMENSIONS, code.shape[1])) * langid._SCALE).astype(np.int32), np.ones(code.shape[1]))
    texts = ["", "x1", "a", None, "été " * 3, "abc " * 90_000, "hello world", "x1", "\n"]
    together = model.predict(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [x[0] for x in model.predict(pa.array([t], pa.string()))] == [x[i] for x in together]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sorted(map(str, langid.identify(x, model).collect())) for x in (df.repartition(1), df.repartition(5).orderBy(F.rand(3))))
    assert one == two
    clash = df.withColumns({"score": F.lit("own"), "ambiguous": F.lit(7)})
    assert langid.identify(clash, model, out=("p", "q", "r")).where("score = 'own' AND ambiguous = 7").count() == len(rows)


def test_language_features_and_decoding_against_brute_force():
    texts = ["Aé b", "", None, "zz"]
    codes, offs = langid._features(pa.array(texts))
    for i, t in enumerate(texts):
        raw = [b if 97 <= b <= 122 or b >= 128 else 32 for b in ((t or "").lower() + "  ").encode()]
        want = []
        for x, y, z in zip(raw, raw[1:], raw[2:]):
            h = (x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) % 2**32
            want.append((((h ^ h >> 15) * 0x2C1B3C6D) % 2**32) >> 16)
        assert codes[offs[i] : offs[i + 1]].tolist() == want
    rng = np.random.default_rng(2)
    code, trust = langid.codewords(5), rng.random(15)
    model = langid.Model(tuple("abcde"), code, (rng.normal(size=(langid.DIMENSIONS, 15)) * langid._SCALE).astype(np.int32), trust)
    names, score, close = model.predict(pa.array(texts))
    for i, t in enumerate(texts):
        if not t:
            assert (names[i], score[i], close[i]) == ("und", 0, True)
            continue
        own = codes[offs[i] : offs[i + 1]].astype(int)
        margin = np.clip(model.weights[own].astype(float).sum(axis=0) / len(own) / langid._SCALE, -4, 4)
        loss = [sum(trust[b] * np.exp(-int(code[k, b]) * margin[b]) for b in range(15)) / trust.sum() for k in range(5)]
        first, second = sorted(loss)[:2]
        assert names[i] == "abcde"[int(np.argmin(loss))] and score[i] == pytest.approx(second / (first + second))
        assert close[i] == (second - first < langid.AMBIGUOUS * first)
    tie = langid.Model(("a", "b"), np.array([[1], [-1]], np.int8), np.zeros((langid.DIMENSIONS, 1), np.int32), np.ones(1))
    assert [x[0] for x in tie.predict(pa.array(["word"]))] == ["a", 0.5, True]


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = langid.codewords(n).astype(int)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= max(1, code.shape[1] // 4)


def test_licenses_against_brute_force(spark, docs, empty):
    found = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    units = ["Released under the MIT License.", "Licensed under the Apache License, version 2.0", "nothing of the kind", "", "MIT", MIT, MIT.replace("Software", "Work", 3), licenses._GPL[:200]]
    for u in units:
        best = max(((licenses.dice(licenses.bigrams(u), licenses.bigrams(t)), n) for n, ts in licenses.TEMPLATES.items() for t in ts), key=lambda x: x[0])
        got = found.best(u)
        assert (got is None) == (best[0] < licenses.THRESHOLD)
        assert got is None or got[1] == pytest.approx(best[0])
    rows = [(1, "some words\nReleased under the MIT License.\nmore"), (2, "a b. Licensed under CC BY-NC 4.0. c d e f g h i j"), (3, None), (4, "intro\n\n" + MIT + "\n\nend")]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "MIT:11:42" and got[2].licenses == "CC-BY-NC-4.0" and got[3].n_hits == 0
    assert got[4].licenses == "MIT" and got[4].n_hits == 1
    assert licenses.report(docs).where("n_hits > 0").count() == 0 and licenses.report(empty).count() == 0


def test_licenses_over_paragraphs_and_line_ends(spark):
    found = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    cut = MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    head = "MIT License\n\nCopyright (c) 2020 Some One\n\n"
    assert cut.count("\n\n") == 2
    assert [h[:3] for h in found.scan(cut)] == [(0, len(cut), "MIT")]
    assert [h[:3] for h in found.scan(head + cut + "\n\nother words of another kind")] == [(len(head), len(head + cut), "MIT")]
    assert [h[:3] for h in found.scan(cut + "\n\n" + cut)] == [(0, len(cut), "MIT"), (len(cut) + 2, 2 * len(cut) + 2, "MIT")]
    wrapped = "Some words first. Licensed under the\nMIT License. More words that follow it\nand go on for a while."
    assert [h[:3] for h in found.scan(wrapped)] == [(18, 49, "MIT")] and wrapped[18:49] == "Licensed under the\nMIT License."
    wrapped = "This work is licensed under a Creative Commons Attribution\n-NonCommercial 4.0 International License."
    assert [h[2] for h in found.scan("Some words first. " + wrapped + " More words of another kind that follow.")] == ["CC-BY-NC-4.0"]
    notice = "Released under the MIT License."
    assert [h[:3] for h in found.scan("\n\n".join([notice] * 500))] == [(33 * i, 33 * i + 31, "MIT") for i in range(500)]


def brute_units(text, threshold=0.8):
    """Every run of paragraphs with the nearest template's name and Dice coefficient, where it reaches the threshold."""
    templates = [(n, licenses.bigrams(t)) for n, ts in licenses.TEMPLATES.items() for t in ts]
    spans = [m.span() for m in re.finditer(r"[^\n]+(?:\n[^\n]+)*", text)]
    out = []
    for i, (a, _) in enumerate(spans):
        for _, b in spans[i:]:
            own = licenses.bigrams(text[a:b])
            d, n = max((licenses.dice(own, t), n) for n, t in templates)
            if d >= threshold:
                out.append((a, b, n, d))
    return out


def test_whole_licence_files_are_found():
    found, head = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD), "Copyright (c) 2021, A Name and Another\n\n"
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "Zlib", "Unlicense", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1"):
        text = licenses.TEMPLATES[name][-1]
        assert [h[2] for h in found.scan(head + text)] == [name]
        assert name in {h[2] for h in found.scan("Other words of a readme.\n\n" + text.replace("\n", "\r\n") + "\n\nThe end of it.")}
        half = " ".join(text.split()[::2])
        assert not found.scan(half)
    for notice in (licenses._APACHE, licenses._GPL):
        assert len(found.scan("\n".join("# " + x for x in notice.splitlines()))) == 1


def layouts(text):
    """A licence text as files have it: line ends, blank lines that hold spaces, comments with code below, one line."""
    lines = text.strip().splitlines()
    return {
        "lf": "\n".join(lines), "crlf": "\r\n".join(lines), "cr": "\r".join(lines), "spaces": "\n".join(x if x.strip() else "   " for x in lines), "one line": " ".join(text.split()),
        "hash": "\n".join(f"# {x}".rstrip() for x in lines), "slashes": "\n".join(f"// {x}" for x in lines), "star": "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */", "indent": "\n\n".join(f"    {x}" for x in lines),
    }


@pytest.mark.parametrize("name", sorted(p.stem for p in (licenses.Path(licenses.__file__).parent / "licence_texts").glob("*.txt")))
def test_every_layout_of_a_licence_is_found_once(name):
    found, rng = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD), random.Random(7)
    other = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    code = "int main(void) {\n  return run(argc, argv);\n}\n"
    for kind, text in layouts(licenses.TEMPLATES[name][-1]).items():
        for before, after in ((other(60) + "\n\n", "\n\n" + other(60)), ("", "\n" + code), (other(9) + "\n", "\n" + other(9))):
            hits = found.scan(before + text + after)
            assert [h[2] for h in hits] == [name], (kind, hits)
            assert abs(hits[0][0] - len(before)) < 0.1 * len(text) + 40 and abs(hits[0][1] - len(before + text)) < 0.1 * len(text) + 40


def test_joined_licences_are_scanned_in_one_pass():
    import time

    found = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    text = licenses.TEMPLATES["GPL-3.0"][-1]
    many = "\n\n".join([text] * (1 + 700_000 // len(text)))
    start = time.process_time()
    hits = found.scan(many)
    assert time.process_time() - start < 4 * len(many) / 1e6
    assert [h[2] for h in hits] == ["GPL-3.0"] * (1 + 700_000 // len(text))


def test_scan_against_brute_force():
    found, rng = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD), random.Random(4)
    parts = [p for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib") for p in licenses.TEMPLATES[n][-1].split("\n\n")] + ["some other words", "Released under the MIT License.", "x"]
    for _ in range(60):
        at = rng.randrange(len(parts))
        text = "\n\n".join(rng.choice(parts) if rng.random() < 0.15 else parts[(at + i) % len(parts)] for i in range(rng.randint(1, 8)))
        units, hits = brute_units(text), found.scan(text)
        assert all(d >= 0.8 - 1e-9 for *_, d in hits) and all(x[1] <= y[0] for x, y in zip(hits, hits[1:]))
        assert all(any(a < h[1] and h[0] < b for h in hits) for a, b, _, _ in units), text
        runs = {(a, b): n for a, b, n, _ in units}
        assert all(runs.get(h[:2], h[2]) == h[2] for h in hits)


def test_licences_with_clashes_ties_and_repeated_rows(spark):
    ties = {"B": ("one two three four",), "A": ("one two three four",)}
    df = spark.createDataFrame([(1, "one two three four"), (1, "one two three four"), (None, None), (2, "x " * 50_000)], "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    got = licenses.scan(df, ties).collect()
    assert sorted((r.doc_id or 0, tuple(h.license for h in r.licenses)) for r in got) == [(0, ()), (1, ("A",)), (1, ("A",)), (2, ())]


def test_counted_terms():
    u, c = fingerprints._counted(np.array([3, 1, 3], np.uint64))
    assert Counter(dict(zip(u.tolist(), c.tolist()))) == {3: 2, 1: 1}
