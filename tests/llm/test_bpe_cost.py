"""What op5 may not spend its time on, and what its memory may not change."""

import gc
import hashlib
import random

import public_tokenizers

from threadloom.llm import bpe, common
from threadloom.llm.queries import VOCABULARY


def _codec(remember=bpe.REMEMBER):
    path = public_tokenizers.path(VOCABULARY)
    return bpe.BytePairCodec(bpe.read_ranks(path), public_tokenizers.PATTERN, remember)


def test_no_cycles_are_sought_while_texts_are_encoded():
    rng, codec = random.Random(2), _codec()
    texts = [None, "", *[" ".join("".join(rng.choices("abcdeéß.", k=9)) for _ in range(1000)) for _ in range(30)]]
    runs = []
    note = lambda phase, info: runs.append(info)
    gc.callbacks.append(note)
    try:
        got = bpe.digests(codec, texts)
        during = len(runs)
    finally:
        gc.callbacks.remove(note)
    assert during == 0 and gc.isenabled()
    for t, (n, ids, data) in zip(texts, got, strict=True):
        want = codec.encode(t or "")
        assert (n, ids, data) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_forgetting_within_a_text_changes_nothing():
    rng = random.Random(3)
    text = " ".join(rng.choice(["word", "Wort,", "número", "xq" * rng.randint(1, 9), "12345!"]) for _ in range(500))
    whole, small = _codec(), _codec(remember=3)
    assert small.encode(text) == whole.encode(text) and small.encode(text) == whole.encode(text)
    assert len(small.recent) <= 3 and len(small.older) <= 3
    assert small.decode(small.encode(text)) == text.encode()


def test_a_codec_let_go_leaves_no_memory():
    common.let_go()
    common.kept("bpe-cost", lambda: _codec(remember=100)).encode("some words to remember")
    common.let_go()
    assert not [x for x in gc.get_objects() if isinstance(x, bpe.BytePairCodec) and x.remember == 100]
