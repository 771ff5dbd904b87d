"""The ten operators: odd inputs, and brute-force versions on small fixtures."""

import gc
import hashlib
import io
import math
import random
import weakref
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import chunk_dedup, components, decontaminate, lang_id, lm_scoring, packing, sharding, shingle_join, simhash, suffix_dedup, token_store, transport_stream
from quarry.llm.tokenize import encoder

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = ["alpha", "béta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "the", "of"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, spans string, score string, slot string, print string, component_id string, prints string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n)) + ".\n"


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(1, 20_000)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, prose(2, 120)), (6, prose(2, 120)), (7, prose(2, 120)), (7, prose(2, 120)), (None, "no id here"), (None, None), (8, "a"), (9, "1 2 3 !!"), (10, "x" * 5000), (11, "\x00 　 日本 <|endoftext|>")]
    return spark.createDataFrame([(i, t, "en" if t else None, None, None, *["clash"] * 8) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(2, 30)), (2, None), (3, ""), (4, "a")], "item_id long, text string")


OPERATORS = {
    "packing": lambda d: packing.pack_documents(d, BYTE_BPE),
    "token_store": lambda d: token_store.round_trip(d, WORD_BPE),
    "chunk_dedup": chunk_dedup.repeated_runs,
    "simhash": simhash.near_duplicates,
    "transport_stream": transport_stream.document_features,
    "lm_scoring": lm_scoring.score_documents,
    "sharding": sharding.shard_documents,
    "suffix_dedup": suffix_dedup.remove_repeats,
    "lang_id": lang_id.predictions,
}
PER_ROW = {"token_store", "simhash", "transport_stream", "lm_scoring", "sharding", "suffix_dedup", "lang_id"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, odd, name):
    rows = OPERATORS[name](odd).collect()
    if name in PER_ROW:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_decontamination_of_odd_rows(spark, odd, benchmark):
    assert sorted(r.doc_id for r in decontaminate.contaminated(odd, benchmark).collect()) == [5, 6, 7, 7, 8]
    left = decontaminate.decontaminate(odd, benchmark)
    assert left.columns == odd.columns and left.count() == odd.count() - 5
    assert decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(odd.limit(0), benchmark).count() == 0


def test_pipeline_keeps_columns(spark, odd, tmp_path):
    odd.limit(0).union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_near_dedup_keeps_texts_that_share_or_lack_an_id(spark):
    rows = [(None, "a " + prose(1, 40)), (None, "b " + prose(2, 40)), (7, prose(3, 40)), (7, prose(4, 40)), (7, prose(4, 40)), (3, prose(4, 40)), (None, prose(3, 40))]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in (rows[0], rows[1], rows[2], rows[5]))


def test_sum_of_squares_against_plain_rule():
    lengths = np.array([random.Random(5).randrange(1, 60) for _ in range(400)])
    gaps, where, got = Counter(), [], packing.sum_of_squares(lengths, 60)
    for s, b in zip(lengths.tolist(), got.tolist(), strict=True):
        def change(g, s=s):
            n = Counter(gaps)
            if g < 60:
                n[g] -= 1
            if g - s:
                n[g - s] += 1
            return sum(v * v for v in n.values())
        best = min(change(g) for g in [*[g for g, v in gaps.items() if v and g >= s], 60])
        g = where[b] if b < len(where) else 60
        assert change(g) == best
        if b == len(where):
            where.append(60)
        else:
            gaps[g] -= 1
        where[b] -= s
        if where[b]:
            gaps[where[b]] += 1
    assert min(where) >= 0


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(k, prose(k, 40 * k)) for k in range(60)], "doc_id long, text string")
    rows = packing.pack_documents(docs, BYTE_BPE).collect()
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048
    ids = np.append(encoder(BYTE_BPE).encode([prose(59, 40 * 59)])[0].astype("<u4"), np.uint32(0))
    mine = sorted((r for r in rows if r.doc_id == 59), key=lambda r: r.piece)
    assert sum(r.length for r in mine) == len(ids) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine) and {r.length for r in mine[1:]} <= {2048}


def test_words_encode_as_in_their_text():
    from tokenizers import Tokenizer

    for path in (BYTE_BPE, WORD_BPE):
        plain = Tokenizer.from_file(path)
        for text in ("a  b", " a b ", "x \n y", "\n\nfoo  bar", "a b c   d", "<|endoftext|> x", "x <|endoftext|> y", "a b<|endoftext|>c <|startoftext|>", "<|endoftext| >", "", "  ", "É ñ's don't I'LL 12345", "a\x1cb \x1c c", "é ́x", "日本 語", "ΑΣ ΣΑΣ"):
            assert encoder(path).encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_file_reads_only_asked_frames():
    out = io.BytesIO()
    w = token_store.Writer(out, 2)
    docs = [np.random.default_rng(k).integers(0, 60_000, 40_000, dtype=np.uint16) for k in range(12)]
    for k, ids in enumerate(docs):
        w.add(k, ids.tobytes())
    w.close()
    data = out.getvalue()
    r = token_store.Reader(io.BytesIO(data))
    assert len(r.frames) > 2 and all((r.document(k) == ids).all() for k, ids in enumerate(docs))
    assert all((a == b).all() for a, b in zip(r.documents(), docs, strict=True))
    broken = token_store.Reader(io.BytesIO(data[:8] + bytes([data[8] ^ 1]) + data[9:]))
    with pytest.raises(Exception, match=".+"):
        broken.document(0)
    assert (broken.document(11) == docs[11]).all()


def test_tiling_finds_reordered_passages():
    item = list(range(40))
    text = [99] * 5 + item[20:] + [98] * 3 + item[:20] + [97]
    tiles = decontaminate.tile(item, text)
    assert sum(k for *_, k in tiles) == 40 and [k for *_, k in tiles] == [20, 20]
    assert decontaminate.tile(item, [1, 2, 3] * 5) == []


def test_chunks_resist_shifts():
    body = prose(3, 400).encode()
    cut = lambda b: {b[x:y] for x, y in chunk_dedup.chunks(b)}
    assert b"".join(body[x:y] for x, y in chunk_dedup.chunks(body)) == body
    assert len(cut(body) & cut(b"something new " + body)) > 0.9 * len(cut(body))


@pytest.mark.parametrize("least", [0, 64])
def test_repeated_chunks_against_brute_force(spark, least):
    shared, line = prose(8, 60), prose(9, 12)
    texts = {k: prose(20 + k, 30) + (shared if k % 3 == 0 else "") + prose(80 + k, 20) + (line if k % 2 else "") for k in range(20)}
    texts |= {50: texts[3], 51: None, 52: "", 53: "ab" * 300}
    docs = spark.createDataFrame([*texts.items(), (3, texts[3]), (None, texts[6])], "doc_id long, text string")
    rows = [*texts.items(), (None, texts[6])]
    places = {}
    for k, t in rows:
        for a, b in chunk_dedup.chunks((t or "").encode()):
            places.setdefault((t or "").encode()[a:b], []).append((k is not None, k or 0, a))
    want, kept = [], {}
    for k, t in rows:
        body, run, spans = (t or "").encode(), [], []
        for a, b in [*chunk_dedup.chunks(body), (len(body) + 1, len(body) + 1)]:
            if body[a:b] and len(places[body[a:b]]) > 1:
                run.append((a, b))
                continue
            size = sum(y - x for x, y in run)
            if run and size >= least:
                firsts = [min(places[body[x:y]]) for x, y in run]
                own = [f == (k is not None, k or 0, x) for f, (x, _) in zip(firsts, run, strict=True)]
                want.append((str(k), run[0][0], size, len(run), sum(own)))
                spans += [r for r, o in zip(run, own, strict=True) if not o]
            run = []
        left = b"".join(body[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(body)], strict=True))
        kept[k] = None if t is None else left.decode()
    got = chunk_dedup.repeated_runs(docs, least).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.n_chunks, r.n_first) for r in got) == sorted(want)
    assert {r.doc_id for r in got} >= {50, None, *range(0, 20, 3)} and all(sum(d.size for d in r.duplicates) <= r.length for r in got)
    out = chunk_dedup.deduplicated(docs, least).collect()
    assert len(out) == len(rows) + 1 and all(r.kept_text == kept[r.doc_id] for r in out)
    assert all(r.removed_bytes == len((r.text or "").encode()) - len((r.kept_text or "").encode()) for r in out)


def _plain_tiles(pattern, text, least):
    """Greedy string tiling as published: mark the longest free matches, again and again."""
    used_p, used_t, covered = set(), set(), 0
    while True:
        best, found = least, []
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and p + k not in used_p and t + k not in used_t:
                    k += 1
                if k > best:
                    best, found = k, [(p, t)]
                elif k == best:
                    found.append((p, t))
        if not found:
            return covered
        for p, t in found:
            if not used_p & set(range(p, p + best)) and not used_t & set(range(t, t + best)):
                used_p |= set(range(p, p + best))
                used_t |= set(range(t, t + best))
                covered += best


def test_decontamination_against_plain_tiling(spark):
    draw = random.Random(12)
    items = {k: " ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(draw.randrange(4, 14))) for k in range(12)}
    items |= {20: "Two words", 21: "!!", 22: None}
    texts = {}
    for k in range(60):
        words = items[k % 12].split()
        cut = draw.randrange(1, len(words))
        texts[k] = " ".join([*("zz" for _ in range(draw.randrange(4))), *words[cut:], *(["yy"] * draw.randrange(3)), *words[: max(1, cut - draw.randrange(4))]])
    texts |= {100: "two, WORDS!", 101: "two words more", 102: None, 103: ""}
    want = set()
    for d, t in texts.items():
        for i, x in items.items():
            a, b = decontaminate.tokens(x or ""), decontaminate.tokens(t or "")
            if a and (min(len(a), len(b)) >= 4 and _plain_tiles(a, b, 4) >= 0.6 * len(a) or len(a) < 4 and a == b):
                want.add((d, i))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (decontaminate.BLOCK_TOKENS, 5):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_tokens=block).collect()}
        assert got == want and (100, 20) in got and 10 < len(got)
    left = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in want}


def test_token_store_columns(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_BPE)
    texts = {9: None, 3: "", 5: "x <|endoftext|> y", 1: prose(1, 3000), 7: "ÉÈ  ñ's\n", 2: prose(1, 10)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    start, want = 0, []
    for k in sorted(texts):
        ids = np.array([*plain.encode(texts[k] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_store.round_trip(docs, WORD_BPE).collect()) == want


def test_fingerprint_against_plain_rule():
    draw = random.Random(6)
    for n in (0, 1, 3, 4, 5, 40):
        text = " ".join(draw.choice(["Über", "ab", "AB", "c\x0bd", "日本"]) for _ in range(n))
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").split(" ") if text else []
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text.encode()) == [want]


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_wide_simhash_links_at_similarity_of_a_document_pair(spark):
    draw = np.random.default_rng(5)
    texts, expected = {}, {}
    for k in range(0, 600, 3):
        words = [f"w{x}" for x in draw.integers(0, 5000, 300)]
        changed = list(words)
        while len(_shingles(" ".join(words)) & _shingles(" ".join(changed))) / len(_shingles(" ".join(words)) | _shingles(" ".join(changed))) > 0.86:
            changed[draw.integers(0, 300)] = f"x{draw.integers(0, 5000)}"
        half = words[:150] + [f"y{x}" for x in draw.integers(0, 5000, 150)]
        texts |= {k: " ".join(words), k + 1: " ".join(changed), k + 2: " ".join(half)}
        expected |= {k: k, k + 1: k, k + 2: k + 2}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (shingle_join.BLOCK, 1):
        got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs, block=block).collect()}
        missed = [k for k in got if k % 3 == 1 and got[k] != expected[k]]
        assert len(missed) <= 12 and all(got[k] == expected[k] for k in got if k % 3 != 1)


def _jaccard_groups(texts):
    sets, root = {k: _shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    links = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_dedup_links_at_exact_jaccard_only(spark):
    draw, texts = random.Random(11), {}
    for k in range(0, 240, 2):  # pairs on both sides of 0.8
        words = prose(500 + k, 80).split()
        changed = list(words)
        for at in draw.sample(range(80), draw.randrange(1, 5)):
            changed[at] = f"other{at}"
        texts |= {k: " ".join(words), k + 1: " ".join(changed)}
    line = "this one line stands in very many of them\n"
    texts |= {k: line * 40 + prose(900 + k, 100) for k in range(240, 270)}  # near by weight, not by set
    star = prose(7, 60).split()
    texts |= {k: " ".join([*star[: k % 40], f"new{k}", *star[k % 40 + 1 :]]) for k in range(270, 310)}  # one large bucket
    want = _jaccard_groups(texts)
    assert 30 < sum(want[k + 1] == k for k in range(0, 240, 2)) < 110
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (shingle_join.BLOCK, 3):
        assert {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs, block=block).collect()} == want


def test_simhash_groups_against_brute_force(spark):
    texts = {k: prose(k // 3, 60 + k % 3 * (k % 2)) for k in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {k: simhash.fingerprint(t.encode())[0] for k, t in texts.items()}
    root = {k: k for k in prints}
    for _ in range(len(root)):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = min(root[a], root[b])
    for hot in (20_000, 3):
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, hot_bucket=hot).collect()} == root


def test_gray_index_on_dense_balls():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for c in centre]))
    bucket = np.zeros(len(points), np.int64)
    got = simhash.GrayIndex(bucket, points).components(4)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    label = np.arange(len(points))
    while True:
        new = np.where(near, label[None, :], len(points)).min(1)
        if (new == label).all():
            break
        label = new
    assert len(set(zip(got.tolist(), label.tolist(), strict=True))) == len(set(label.tolist())) == len(set(got.tolist()))


def test_components_of_long_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    assert {r.node: r.root for r in components.connected_components(e).collect()} == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_transport_stream_round_trip_and_faults():
    for n in (0, 1, 63, 64, 150, 176, 184, 8192, 8193, 40_000):
        payload = transport_stream.padded(bytes(k % 251 for k in range(n)))
        s = transport_stream.parse(media := transport_stream.multiplex(payload))
        assert s.payload == payload and (s.discontinuities, s.bad_sections, s.lost_bytes) == (0, 0, 0) and len(media) % 188 == 0
    assert [u[0] for u in s.units] == [k * 3003 for k in range(5)] and [u[1] for u in s.units] == [True, False, False, False, True]
    gap = transport_stream.parse(media[: 188 * 10] + media[188 * 11 :])
    assert gap.discontinuities == 1
    broken = transport_stream.parse(media[:20] + bytes([media[20] ^ 255]) + media[21:])
    assert broken.bad_sections == 1 and broken.units == [] and broken.programs == {}
    assert transport_stream.parse(b"").units == []
    twice = transport_stream.parse(media[: 188 * 11] + media[188 * 10 :])
    assert twice.payload == payload and twice.discontinuities == 0
    thrice = transport_stream.parse(media[: 188 * 11] + media[188 * 10 : 188 * 11] + media[188 * 10 :])
    assert thrice.discontinuities == 1
    shifted = transport_stream.parse(media[: 188 * 6] + b"junk" + media[188 * 6 :])
    assert shifted.payload == payload and shifted.lost_bytes == 4
    cut = transport_stream.parse(media[: 188 * 6] + media[188 * 6 + 50 :])
    assert cut.lost_bytes == 138 and cut.discontinuities == 1


def test_transport_stream_columns(spark):
    texts = {1: None, 2: "", 3: "abc", 4: "é" * 100, 5: prose(4, 3000), 6: prose(4, 3000), 7: "x" * 64}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in transport_stream.document_features(docs).collect()}
    for k, t in texts.items():
        body = (t or "").encode()
        payload = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
        media = transport_stream.multiplex(payload)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and "discontinuities=0;bad_sections=0;lost=0" in r.feature
    assert rows[5].feature == rows[6].feature and rows[1].media_sha256 == rows[2].media_sha256


def test_lm_base_and_normalisation(spark):
    docs = spark.createDataFrame([(k, prose(k % 7, 30)) for k in range(60)], "doc_id long, text string")
    rows = lm_scoring.score_documents(docs).collect()
    words = {k: t.lower().split() + ["\n"] for k, t in ((r.doc_id, r.text) for r in docs.collect())}
    c = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        assert r.train_tokens == n and r.n_tokens == len(words[r.doc_id]) and r.n_known == sum(c[w] > 0 for w in words[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words[r.doc_id]))
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_probabilities_of_all_words_sum_to_one():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    counts = np.minimum(draw.zipf(1.3, 3000), 100_000).astype(np.int64)
    total = int(counts.sum())
    kinds, codes = lm_scoring.classes_of(counts, total), lm_scoring.codes_of(words)
    assert all(counts[k] * 16**t >= total and (t == 1 or counts[k] * 16 ** (t - 1) < total) for k, t in enumerate(kinds.tolist()))
    leaf, which = np.unique(lm_scoring._leaf(kinds, codes), return_inverse=True)
    prior = lm_scoring.Prior(leaf, np.bincount(which, counts))
    weights = draw.normal(size=(1 << 12, 16)).astype(np.float32)
    history = [np.full(3001, x) for x in draw.integers(0, 1 << 63, 3, dtype=np.uint64)]
    tokens = lm_scoring.Tokens.__new__(lm_scoring.Tokens)
    tokens.features = history
    log_p = np.append(np.log(counts / prior.leaves.reshape(-1)[lm_scoring._leaf(kinds, codes)]), 0.0)
    kinds, codes = np.append(kinds, 0), np.append(codes, 0)  # and the class of unknown words
    for level in range(lm_scoring.DEPTH + 1):
        at = np.flatnonzero((np.minimum(kinds, lm_scoring.DEPTH) >= level) | (level == 0))
        node, outcome = lm_scoring._factors(kinds[at], codes[at], np.full(len(at), level))
        log_p[at] += lm_scoring.log_probabilities(weights, prior.log, node, tokens.rows(at, node, 12), outcome)
    assert np.exp(log_p).sum() == pytest.approx(1, abs=1e-3)


def test_lm_update_goes_down_the_gradient():
    draw = np.random.default_rng(3)
    weights, prior = draw.normal(size=(64, 16)).astype(np.float32), np.log(np.full((4, 16), 1 / 16)).astype(np.float32)
    node, rows, outcome = np.array([1, 2, 1]), [np.array([3, 9, 3])], np.array([5, 0, 7])

    def loss(w):
        return -lm_scoring.log_probabilities(w, prior, node, rows, outcome).sum()

    numeric = np.zeros((64, 16))
    for i in (3, 9):
        for j in range(16):
            moved = weights.astype(np.float64).copy()
            moved[i, j] += 1e-3
            numeric[i, j] = (loss(moved) - loss(weights.astype(np.float64))) / 1e-3
    after, times = weights.copy(), np.zeros(64, np.int32)
    lm_scoring.update(after, np.zeros(64, np.float32), times, prior, node, rows, outcome)
    step = (after - weights).astype(np.float64)
    assert times[3] == 2 and times[9] == 1 and times.sum() == 3
    for i in (3, 9):
        scale = lm_scoring.RATE / np.sqrt((numeric[i] ** 2).mean() + 1)
        assert np.allclose(step[i], -scale * numeric[i], atol=1e-3)
    assert not step[[k for k in range(64) if k not in (3, 9)]].any()


def test_lm_scores_against_a_plain_version(spark):
    docs = spark.createDataFrame([(k, prose(k % 7, 30) if k % 11 else None) for k in range(40)] + [(None, "a  A\tb"), (3, prose(3, 30))], "doc_id long, text string")
    model = lm_scoring.train(docs)
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in lm_scoring.score_documents(docs).collect())
    words = {}
    for r in docs.collect():
        for w in (r.text or "").encode().lower().split() + [b"\n"]:
            words.setdefault(w, 0)
            words[w] += r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 > 0
    known = {w: (lm_scoring.word_hashes([w], np.array([int.from_bytes(w[-3:], "big")], np.uint32))[0], c) for w, c in words.items()}
    weights, bits = model.weights.astype(np.float32), len(model.weights).bit_length() - 1
    mask = (1 << 64) - 1

    def mixed(x):
        return (x ^ x >> 32) & mask

    def one(w, back):
        h, c = known[w]
        if not c:
            kind, digits, left = 0, [], 0.0
        else:
            kind = next(t for t in range(1, 16) if c * 16**t >= model.total)
            digits = [int(h) >> 60 & 15, int(h) >> 56 & 15, int(h) >> 52 & 15][:kind]
            same = sum(d for g, d in known.values() if d and next(t for t in range(1, 16) if d * 16**t >= model.total) == kind and [int(g) >> 60 & 15, int(g) >> 56 & 15, int(g) >> 52 & 15][:kind] == digits)
            left = math.log(c / same)
        m = [int(x) for x in lm_scoring._MIX]
        a, b = (int(known[x][0]) * m[0] & mask for x in back)
        ea, eb = (int.from_bytes(x[-3:], "big") * m[0] & mask for x in back)
        features = [mixed(a), mixed((b + m[3]) & mask), mixed((ea * m[3] & mask) ^ eb)]
        node, before = 0, 0
        for k, outcome in enumerate([kind, *digits]):
            if k:
                node = 1 + kind * 273 + (0, 1, 17)[k - 1] + before
                before = before * 16 + outcome
            rows = [((f ^ (node * m[1] & mask)) * m[2] & mask) >> (64 - bits) for f in features]
            x = model.prior.log[node].astype(float) + sum(weights[r].astype(float) for r in rows)
            left += x[outcome] - math.log(np.exp(x).sum())
        return left

    want = []
    for r in docs.collect():
        ws = [b"\n", b"\n", *(r.text or "").encode().lower().split(), b"\n"]
        want.append((str(r.doc_id), round(sum(one(ws[k], (ws[k - 1], ws[k - 2])) for k in range(2, len(ws))) / math.log(10), 4)))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and np.allclose([x for _, x in got], [x for _, x in sorted(want)], atol=0.02)


def test_sharding_columns_and_laws(spark):
    texts = {k: None if k % 50 == 0 else "é" * (k % 9) for k in range(4000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and 100 < sum(r.grown_shard == 16 for r in rows) < 400
    assert all(r.size == 1 + len((texts[r.doc_id] or "").encode()) and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "key" for r in rows)
    assert all(r.region == r.shard // 8 and r.rack == r.shard // 4 for r in rows)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and 170 < len(slots) < 340


def test_sharding_grows_into_the_new_shard_only(spark):
    docs = spark.createDataFrame([(k,) for k in range(3000)], "doc_id long")
    for n in (1, 3, 7, 8, 23):
        tree = sharding.even_tree(n)
        twice = sharding.grown(sharding.grown(tree))
        frames = docs
        for name, t in (("a", tree), ("b", sharding.grown(tree)), ("c", twice)):
            frames = sharding.with_shard(frames, ["doc_id"], t, name)
        rows = frames.collect()
        assert {r.b for r in rows if r.a != r.b} == {n} and {r.c for r in rows if r.b != r.c} == {n + 1}
        assert abs(sum(r.b == n for r in rows) - 3000 / (n + 1)) < 6 * (3000 / (n + 1)) ** 0.5


def test_sharding_confines_moves_to_changed_subtrees(spark):
    docs = spark.createDataFrame([(k, "x") for k in range(6000)], "doc_id long, k0 string")
    tree = sharding.even_tree(16)
    heavier = [[[(s, 4.0 if s == 5 else w) for s, w in rack] for rack in region] for region in tree]
    both = sharding.with_shard(sharding.with_shard(docs, ["doc_id"], tree, "a"), ["doc_id"], heavier, "b").collect()
    moved = [(r.a, r.b) for r in both if r.a != r.b]
    assert moved and all(b // 8 == 0 for a, b in moved if a // 8 != b // 8)  # between regions: into that of 5
    assert all(b // 4 == 1 for a, b in moved if a // 8 == b // 8 and a // 4 != b // 4)  # between racks of one region: into that of 5
    assert all(b == 5 for a, b in moved if a // 4 == b // 4)
    assert {a // 8 for a, b in moved} == {0, 1}
    light = [[[(s, 0.0 if s in (2, 12, 13, 14, 15) else w) for s, w in rack] for rack in region] for region in tree]
    assert not {r.shard for r in sharding.with_shard(docs, ["doc_id"], light).collect()} & {2, 12, 13, 14, 15}
    with pytest.raises(ValueError, match="positive"):
        sharding.with_shard(docs, ["doc_id"], [[[(0, 0.0)]], []])


def test_sharding_of_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "a", 1, 2, 3, 4), (None, "a", 1, 2, 3, 4), (7, "b", 1, 2, 3, 4), (7, "c", 1, 2, 3, 4)], "doc_id long, text string, piece int, row int, k0 int, at int")
    got = sharding.with_slot(sharding.with_shard(docs, ["doc_id"], sharding.even_tree(16)), "shard", ["doc_id", "text"], slot_rows=1).collect()
    assert len({r.shard for r in got if r.doc_id is None}) == len({r.shard for r in got if r.doc_id == 7}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert got[0].asDict().keys() == {*docs.columns, "shard", "slot"} and {(r.piece, r.row, r.k0, r.at) for r in got} == {(1, 2, 3, 4)}


def test_suffix_dedup_against_brute_force(spark):
    r = random.Random(9)
    shared = [prose(100 + k, 45) for k in range(4)]
    texts = {k: prose(k, r.randrange(5, 60)) + (r.choice(shared) if k % 2 else "") + prose(1000 + k, r.randrange(1, 30)) + (r.choice(shared)[r.randrange(50) :] if k % 3 else "") for k in range(60)}
    texts |= {100: "ab" * 400, 101: "z" * 350, 102: "é" * 150, 103: "", 104: texts[3], 105: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = suffix_dedup.brute_force(texts)
    for limits in ({}, {"hot_segments": 2}):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digests(docs, **limits).collect()}
        assert got == want


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.max("score").alias("most")).first()
    assert rows.right > 0.97 and 0 <= rows.most <= 1


def test_language_id_rejects_scripts_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(4)
    alphabets = ["абвгдежзиклмнопрстуфхцчшя", "αβγδεζηθικλμνξοπρστυφχψω", "的一是在不了有和人这中大为上个国我以要他", "abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz"]
    noise = [" ".join("".join(draw.choice(a) for _ in range(draw.randrange(2, 9))) for _ in range(60)) for a in alphabets for _ in range(40)]
    for known in (docs, docs.where("lang in ('en', 'fr')"), docs.where("lang = 'en'")):
        model = lang_id.learned(known)
        assert all(sum(model.predict(t.encode())[2] for t in noise[k : k + 40]) >= 38 for k in range(0, 200, 40))
        good = lang_id.identify(known.where(lang_id.held_out() & F.col("text").rlike(r"\p{L}")), model)
        assert good.agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.03


def test_language_id_learns_rare_languages(spark):
    rows = [(k, " ".join(chr(0x4E00 + 60 * (k % 70) + j % 60) * 3 for j in range(k, k + 30)), f"l{k % 70:02}") for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(lang_id.train(docs).languages) == 70 and len(lang_id.train(docs, languages=3).languages) == 3


def test_language_id_sends_each_text_once_and_keeps_rows_as_they_are(spark):
    rows = [(1, "plain words here", "a", 0.5), (2, None, "b", 0.1), (3, "1 2 3", "c", 0.2), (4, "1 2 " * 40 + "later words", "d", 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, lang_pred string, score double")
    model = lang_id.train(spark.createDataFrame([(k, t, "en") for k, t in ((1, rows[0][1]), (2, "1 2 " * 40 + "later words"))], "doc_id long, text string, lang string"))
    assert model.languages == ["en"]
    kept = lang_id.keep_identified(docs, model)
    assert "struct(" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.schema == docs.schema and {tuple(r) for r in kept.collect()} <= {rows[0], rows[3]}
    model.least = model.least_seen = 0.0
    assert sorted(tuple(r) for r in lang_id.keep_identified(docs, model).collect()) == [rows[0], rows[3]]
    assert lang_id.keep_identified(docs, None).count() == 0


def test_worker_drops_what_another_step_has_left():
    texts = pa.record_batch([pa.array(["one text", None])], names=["text"])
    for step in (lambda: list(lang_id._keep(SimpleNamespace(value=None), 0)(iter([texts]))), lambda: shingle_join.shingles(b"one text")):
        left = weakref.ref(encoder(BYTE_BPE))
        assert left() is encoder(BYTE_BPE)
        step()
        gc.collect()
        assert left() is None


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: 7, lambda k: k // 2])
def test_language_id_samples_rows_without_or_with_equal_ids(spark, ids):
    rows = [(ids(k), prose(k, 20) if k % 2 else "ñandú año " + prose(k, 20).upper(), "en" if k % 2 else "es") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = lang_id.train(docs, rows_per_language=100)
    assert model.languages == ["en", "es"]
    found = lang_id.identify(docs, model).collect()
    assert len(found) == 1500 and {r.lang_pred for r in found} == {"en", "es"}


def test_language_id_of_one_row_over_and_over(spark):
    docs = spark.createDataFrame([(None, "the same text", "en")] * 3000 + [(1, "un autre texte", "fr")], "doc_id int, text string, lang string")
    model = lang_id.train(docs, rows_per_language=20)
    assert model.languages == ["en", "fr"] and model.predict(b"un autre texte")[0] == "fr"
    assert lang_id.train(docs.limit(0)) is None and lang_id.train(docs.withColumn("text", F.lit("1 2"))) is None


def test_suffix_dedup_of_int_ids(spark):
    text = prose(5, 80)
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id int, text string")
    assert [(r.doc_id, r.n_removed) for r in suffix_dedup.digests(docs).orderBy("doc_id").collect()] == [(1, len(text.encode())), (2, len(text.encode())), (3, 0)]
