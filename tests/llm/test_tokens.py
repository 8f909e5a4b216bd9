"""Encoding of many texts at once, and the parting of a shard's ids."""

import time

import numpy as np
import pytest
from veilwright.llm import tokens, wavelet


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.tokenizer_text(tokens.vocabulary_path())


def test_a_chunk_is_looked_up_once(vocabulary):
    class Counted(tokens.Chunks):
        asked = 0

        def __getitem__(self, chunk):
            self.asked += 1
            return super().__getitem__(chunk)

    chunks = Counted(vocabulary)
    texts = [b"one two  one,two\n" * 500, None, b"Two one" * 300, b""]
    assert chunks.encode_all(texts) == [chunks.whole((t or b"").decode()) for t in texts]
    assert chunks.asked <= 10


def test_odd_texts_together(vocabulary):
    chunks = tokens.Chunks(vocabulary)
    odd = [None, "", " \n\t", "a", "a1", "1a ", "É<|endoftext|>x", "\x00 a\x00", "ſecret K İ it's 'S ÀÉ é naïve ... ?!\"x y　漢字", "éá.", None]
    raw = [None if t is None else t.encode() for t in odd]
    want = [chunks.whole(t or "") for t in odd]
    assert chunks.encode_all(raw) == want and [chunks.encode(t) for t in raw] == want
    assert chunks.encode_all([]) == []


@pytest.mark.parametrize("stretch", [1, 7, 64, 5000])
def test_ids_are_parted_in_stretches(monkeypatch, stretch):
    monkeypatch.setattr(wavelet, "STRETCH", stretch)
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 70_000, 1000), rng.choice([0, 1, 49_407], 64), np.zeros(0, int), np.array([7])):
        matrix = wavelet.load(wavelet.dump([1], [len(ids)], wavelet.WaveletMatrix.build(ids)))[2]
        assert (matrix.decode() == ids).all() and (matrix.access(np.arange(len(ids))) == ids).all()


def test_parting_is_faster_than_by_masks():
    ids = np.random.default_rng(4).integers(0, 1 << 16, 1 << 20).astype(np.uint16)

    def by_masks():
        now = ids
        for shift in range(15, -1, -1):
            bit = (now & np.uint16(1 << shift)) != 0
            parted = np.concatenate([now[~bit], now[bit]])
            above = np.empty_like(now)
            above[~bit], above[bit] = parted[: len(ids) - bit.sum()], parted[len(ids) - bit.sum() :]
            now = parted

    def seconds(call):
        begun = time.process_time()
        call()
        return time.process_time() - begun

    masks, places = zip(*[(seconds(by_masks), seconds(lambda: wavelet.WaveletMatrix.build(ids).decode())) for _ in range(4)], strict=True)
    assert min(places) < 0.8 * min(masks)
