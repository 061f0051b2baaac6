import hashlib
import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlog.llm import bpe as B
from strandlog.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both(tmp_path_factory):
    model, path = B.Model(PATH), tmp_path_factory.mktemp("lexicon") / "x.bin"
    path.write_bytes(B.compiled(model, ["unheard-of", "straße"]))
    return B.Encoder(model, Lexicon(str(path)), memo=50), Tokenizer.from_file(PATH)


def agree(both, text):
    ours, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    got = ours.encode(text).tolist()
    assert got == want, text
    assert ours.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_lexicon_round_trip_and_sharing(tmp_path):
    rng = random.Random(4)
    table = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) + rng.choice([b"", b"ing", b"\xc3\xa9"]): tuple(rng.sample(range(99), rng.randint(0, 3))) for _ in range(900)}
    path = tmp_path / "x.bin"
    path.write_bytes(compile_lexicon(table.items()))
    lexicon = Lexicon(str(path))
    assert all(lexicon.get(k) == v for k, v in table.items())
    assert lexicon.get(b"zz") is None and lexicon.get(b"") is None and lexicon.get(next(iter(table)) + b"q") is None
    path.write_bytes(compile_lexicon([(a + b"tion", (1,)) for a in (b"x", b"y", b"z")]))
    assert Lexicon(str(path)).states == 6


def test_every_letter(both):
    for lo in range(0, 0x11000, 64):
        agree(both, " ".join(f"a{chr(c)}B {chr(c)}" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000))


def test_texts(both):
    for text in ["", " ", "Hello, WORLD's 123 ½ it'll", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "ΟΔΟΣ ΣΑΣ", "é É 가", "x\x1cy\x85z w", "naïve straße 日本語 🙂🙂 \U0001f468‍\U0001f469", "'S 'RE ''ll", "İstanbul ǅ", "\x00\x01"]:
        agree(both, text)
    rng = random.Random(9)
    for _ in range(300):
        agree(both, "".join(rng.choice("aeiounrstAB \n'.,éßΣ9") for _ in range(rng.randint(1, 90))))


def test_long_words(both):
    rng = random.Random(3)
    for n in (99, 100, 101, 150, 700, 5000):
        for letters in ("a", "ab", "etaoinshrdlu", "aé日"):
            word = "".join(rng.choice(letters) for _ in range(n))
            agree(both, word + " x")
    model = both[0].model
    for _ in range(300):
        word = "".join(rng.choice("etaoin") for _ in range(rng.randint(2, 60))).encode()
        parts = [model.first_ids[b] for b in word]
        parts[-1] = model.suffix_ids[word[-1]]
        assert model._merge_long(parts) == model.merge(word)
    began = time.perf_counter()
    agree(both, "".join(rng.choice("etaoinshrdlu") for _ in range(200_000)))
    assert time.perf_counter() - began < 10


def test_query(spark):
    theirs = Tokenizer.from_file(PATH)
    rows = [(1, "One two"), (1, "One two"), (2, None), (None, ""), (3, "long " * 5000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, ids int").repartition(2)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(B.encode(docs, PATH)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), sha(" ".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert B.encode(docs.limit(0), PATH).count() == 0
