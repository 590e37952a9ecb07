import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from skein.llm import packing, sentencepiece_fst, token_store, tokens

from .conftest import TEXTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    return tokens.bpe(*tokens.default_paths())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def _texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()] + TEXTS


def test_ids_are_the_library_s(spark, coder, library):
    for t in _texts(spark):
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_ids_of_odd_white_space(coder, library):
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice([" ", "  ", "\n", "\t", "a", "B's", "12", "é", ".", " ", " ", "'"]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def _brute(pos, pen, window):
    best = [0] + [None] * (len(pos) - 1)
    for j in range(1, len(pos)):
        best[j] = min(best[i] + window - (pos[j] - pos[i]) + pen[j] for i in range(j) if pos[j] - pos[i] <= window)
    return best[-1]


def test_cuts_cost_the_least():
    rng = random.Random(1)
    for _ in range(200):
        window = rng.randrange(5, 30)
        pos = [0]
        for _ in range(rng.randrange(1, 40)):
            pos.append(pos[-1] + rng.randrange(1, window + 1))
        pen = [rng.choice([0, 3, 9]) for _ in pos]
        cuts = packing.choose_cuts(pos, pen, window)
        assert cuts[0] == 0 and cuts[-1] == len(pos) - 1
        cost = sum(window - (pos[b] - pos[a]) + pen[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert all(pos[b] - pos[a] <= window for a, b in zip(cuts, cuts[1:], strict=False))
        assert cost == _brute(pos, pen, window)


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_holds_every_id_once(odd_docs, coder, window):
    rows = packing.pack(odd_docs, window=window).collect()
    docs = {}
    for r in odd_docs.collect():
        docs.setdefault(r.doc_id, []).append(coder.encode(r.text) + np.array([1], "<u4").tobytes())
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.sequence_id, r.offset)):
        assert r.length == len(r.ids) // 4 and 0 < r.length <= window
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    assert {k: len(b"".join(v)) for k, v in docs.items()} == {k: len(v) for k, v in got.items()}
    assert all(got[k] == b"".join(v) for k, v in docs.items())
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window


def test_packing_pads_little(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("sequence_id", "length").collect()
    size = {}
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.values())
    assert pad < 0.01 * sum(size.values())


def test_blocks_do_not_change_what_is_packed(odd_docs, monkeypatch, coder):
    packer = packing.Packer(coder.ends, 64, 0)
    monkeypatch.setattr(packing, "_BLOCK", 500)
    docs = [np.arange(n, dtype="<u4") % 900 for n in (3, 700, 64, 1, 129, 2000, 5)]
    got = [x for i, d in enumerate(docs) for x in packer.add(i, d)] + list(packer.flush(True))
    for i, d in enumerate(docs):
        assert np.concatenate([x[2] for x in got if x[0] == i]).tolist() == d.tolist()


def test_empty_tables(no_docs, tmp_path):
    assert packing.pack(no_docs).count() == 0
    store = token_store.write_store(no_docs, str(tmp_path / "none"))
    assert store.n == 0 and token_store.read_slots(no_docs.sparkSession, store).count() == 0
    assert sentencepiece_fst.encode(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_permutes(n):
    a = token_store.feistel(np.arange(n), n, 7)
    assert sorted(a.tolist()) == list(range(n))
    if n > 100:
        assert (a != token_store.feistel(np.arange(n), n, 8)).mean() > 0.9
        assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.1


def _sequences(docs, coder, length):
    """Padded sequences in input order, partition by partition, as the store must hold them."""
    out = []
    for rows in docs.rdd.glom().collect():
        ids = [x for r in rows for x in [*np.frombuffer(coder.encode(r.text), "<u4").tolist(), 1]]
        for at in range(0, len(ids), length):
            out.append((len(ids[at : at + length]), (ids[at : at + length] + [0] * length)[:length]))
    return out


@pytest.mark.parametrize("per_shard,ranges", [(8, 4), (1000, 1), (3, 7)])
def test_slot_s_holds_the_sequence_that_the_permutation_sends_there(odd_docs, coder, tmp_path, per_shard, ranges):
    spark, length, key = odd_docs.sparkSession, 512, 77
    docs = spark.createDataFrame(odd_docs.collect(), odd_docs.schema)  # the same partitions each time
    want = _sequences(docs, coder, length)
    store = token_store.write_store(docs, str(tmp_path / "s"), key, length, per_shard, ranges)
    n = store.n
    assert n == len(want) and store.stride == 4 + 2 * length + 1
    place = token_store.feistel(np.arange(n), n, key)
    rows = {r.slot: r for r in token_store.read_slots(spark, store).collect()}
    assert sorted(rows) == list(range(n))
    for i, slot in enumerate(place.tolist()):
        r = rows[slot]
        assert (r.shard, r.byte_offset) == (slot // per_shard, slot % per_shard * store.stride)
        assert (r.n_ids, np.frombuffer(r.ids, "<u2").tolist()) == want[i]
    listed = sorted(tuple(r) for r in token_store.manifest(spark, store).select("shard", "first_slot", "n").collect())
    assert listed == [(s, s * per_shard, min(per_shard, n - s * per_shard)) for s in range(-(-n // per_shard))]
    # the files themselves, as a trainer seeks in them
    for r in token_store.manifest(spark, store).collect():
        raw = (tmp_path / "s" / f"range={r.range}" / r.file).read_bytes()
        assert len(raw) == r.n * store.stride == r.bytes
        one = raw[(r.n - 1) * store.stride : r.n * store.stride]
        assert one[4:-1] == bytes(rows[r.first_slot + r.n - 1].ids) and one[-1:] == b"\n"
    part = token_store.read_slots(spark, store, 5, 21).collect()
    assert {r.slot: bytes(r.ids) for r in part} == {s: bytes(rows[s].ids) for s in range(5, min(21, n))}


def test_a_broken_store_is_finished(odd_docs, tmp_path, monkeypatch):
    spark, kept = odd_docs.sparkSession, token_store._write_range
    digest = lambda s: sorted((r.slot, bytes(r.ids)) for r in token_store.read_slots(spark, s).collect())
    whole = digest(token_store.write_store(odd_docs, str(tmp_path / "a"), 5, 256, 4, 4))
    done = []

    def breaks(seqs, path, r, *rest):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(r)
        kept(seqs, path, r, *rest)

    monkeypatch.setattr(token_store, "_write_range", breaks)
    with pytest.raises(RuntimeError):
        token_store.write_store(odd_docs, str(tmp_path / "b"), 5, 256, 4, 4)
    again = []
    monkeypatch.setattr(token_store, "_write_range", lambda seqs, path, r, *rest: (again.append(r), kept(seqs, path, r, *rest)))
    store = token_store.write_store(odd_docs, str(tmp_path / "b"), 5, 256, 4, 4)
    assert again == [2, 3] and digest(store) == whole
    assert digest(token_store.write_store(odd_docs, str(tmp_path / "b"), 5, 256, 4, 4)) == whole and again == [2, 3]


def test_another_call_on_the_same_path_is_refused(odd_docs, tmp_path):
    spark, path = odd_docs.sparkSession, str(tmp_path / "s")
    store = token_store.write_store(odd_docs, path, 1, 256, 4)
    for other in ({"key": 999}, {"per_shard": 8}, {"length": 128}, {"ranges": 2}):
        with pytest.raises(ValueError, match=next(iter(other))):
            token_store.write_store(odd_docs, path, **{"key": 1, "length": 256, "per_shard": 4} | other)
    with pytest.raises(ValueError, match="n_docs"):
        token_store.write_store(odd_docs.limit(3), path, 1, 256, 4)
    again = token_store.write_store(odd_docs.repartition(2), path, 1, 256, 4)
    assert again == store and token_store.read_slots(spark, again).count() == store.n


def test_token_store_query(spark, coder):
    from skein.llm.queries import op4_token_store

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sum(r.n_ids for r in op4_token_store(spark, SF).collect()) == sum(len(coder.encode(t)) // 4 + 1 for t in texts)
    rows = op4_token_store(spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(0 < r.n_ids <= 2048 for r in rows)


def test_sentencepiece_is_the_library_s(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = sentencepiece_fst.transducer(sentencepiece_fst.default_model())
    texts = _texts(spark) + [" " * n + "x" + " " * (40 - n) for n in range(0, 40, 7)]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t or "")
        if t and "▁" not in t:
            assert sentencepiece_fst.decoder(sentencepiece_fst.default_model()).decode(ids) == t


def test_sentencepiece_unigram_shortest_path(tmp_path):
    own = sentencepiece_fst.Transducer(sentencepiece_fst.default_model())
    own.clear()
    own.merges = False
    own.ids = {"▁": 3, "a": 4, "b": 5, "ab": 6, "▁a": 7, "ba": 8}
    own.score = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -2.8, "ba": -1.0}
    own.arcs = own.compile(own.ids)
    own.names = {i: p for p, i in own.ids.items()}
    assert own.path("▁aba") == [7, 8]
    assert own.path("▁abab") == [7, 8, 5]


def test_sentencepiece_query_is_the_library_s(spark):
    import sentencepiece

    from skein.llm.queries import op3_sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(lib.encode(texts[r.doc_id]), "<u4")
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), lib.decode(ids.tolist()) == texts[r.doc_id])


def test_caches_stay_small(monkeypatch):
    monkeypatch.setattr(sentencepiece_fst, "_CACHE", 50)
    monkeypatch.setattr(sentencepiece_fst, "_PAIRS", 50)
    small, large = sentencepiece_fst.Transducer(sentencepiece_fst.default_model()), sentencepiece_fst.transducer(sentencepiece_fst.default_model())
    rng = random.Random(8)
    for _ in range(40):
        t = " ".join("".join(rng.choices("abcdefghijkl", k=rng.randrange(1, 9))) for _ in range(30))
        assert small.encode(t) == large.encode(t)
        assert len(small) <= 50 and small.n_fits <= 50


def test_decoding_replaces_a_column_of_its_name(odd_docs):
    rows = sentencepiece_fst.encode(odd_docs).withColumn("decoded", F.lit(7))
    got = sentencepiece_fst.decode(rows)
    assert got.columns == ["doc_id", "text", "n_ids", "ids", "decoded"] and got.where("decoded = '7'").count() == 0


def test_sentencepiece_frames(odd_docs):
    got = sentencepiece_fst.decode(sentencepiece_fst.encode(odd_docs)).collect()
    assert len(got) == odd_docs.count()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in got)
    assert all(zlib.crc32(bytes(r.ids)) >= 0 and r.n_ids == len(r.ids) // 4 for r in got)
