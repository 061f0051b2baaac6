"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

The driver reads a tokenizer file (the `tokenizers` JSON layout: BPE with an end-of-word suffix over byte-level
letters; NFC, white space folded, lower case), merges the lexicon's words once and compiles them into one file that
every executor gets from Spark and memory-maps. A word is looked up there; an unseen one is merged exactly, and a
bounded memo keeps what a worker has merged. The lexicon holds the words that the vocabulary spells in one token -
those were frequent when the merges were learned - and any further words that are given; it changes no result.

Defined results: a null text is an empty one and has no ids; texts are encoded whole; repeated rows get equal results;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import common as C
from strandlog.llm.lexicon import Lexicon, compile_lexicon

SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers of Unicode after 16, which the tokenizer's engine doesn't know as such but the regex module does.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-3347F"
)
LATER = "".join("-".join(f"\\U{int(x, 16):08X}" for x in span.split("-")) for span in LATER.split())
#: Lower case that Unicode 16 and 17 added and this Python doesn't know.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DC: 0x019B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _pattern(engine, letter: str, number: str, rest: str, *flags: int) -> re.Pattern | regex.Pattern:
    return engine.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{rest}+", *flags)


_latin = [c for c in map(chr, range(256)) if c == c.lower()]
_of = {kind: "".join(map(re.escape, (c for c in _latin if unicodedata.category(c)[0] == kind))) for kind in "LN"}
#: For lower-cased Latin-1 texts, by the faster engine.
LATIN = _pattern(re, f"[{_of['L']}]", f"[{_of['N']}]", rf"[^{SPACE}{_of['L']}{_of['N']}]")
ANY = _pattern(regex, rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]", rf"[[^{SPACE}\p{{L}}\p{{N}}]||[{LATER}]]", regex.V1)
LOWERED = regex.compile("[" + "".join(map(chr, LOWER)) + "]")
MEMO = 600_000
#: From so many bytes on a word is merged with a heap; below, looking at all its pairs is faster.
LONG = 100
_open: dict[str, Lexicon] = {}


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(i) if i in own else chr(next(spare)) for i in range(256)]


class Model:
    """Merges and vocabulary of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.suffix_ids = [self.ids[x + self.suffix] for x in byte_letters()]
        self.first_ids = [self.ids[x] for x in byte_letters()]
        pairs = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        self.ranks = {(self.ids[x], self.ids[y]): rank for rank, (x, y) in enumerate(pairs)}
        self.made = [self.ids[x + y] for x, y in pairs]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.tokens = [""] * (1 + max(chain(self.ids.values(), self.special.values())))
        for token, i in chain(self.ids.items(), self.special.items()):
            self.tokens[i] = token
        self.letters = byte_letters()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word: again and again the pair of lowest rank, the first of equal ones, becomes one."""
        parts = [self.first_ids[b] for b in word]
        parts[-1] = self.suffix_ids[word[-1]]
        if len(parts) > LONG:
            return self._merge_long(parts)
        rank, none = self.ranks.get, len(self.made)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = (self.made[least],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same by a heap of (rank, place) and neighbours' links; a pair that has changed since it was put there is skipped."""
        n, rank, none = len(parts), self.ranks.get, len(self.made)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = [*(rank(pair, none) for pair in zip(parts, parts[1:])), none]
        heap = [(x, i) for i, x in enumerate(ranks) if x < none]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            if ranks[i] != least:
                continue
            gone, parts[i] = after[i], self.made[least]
            parts[gone], ranks[gone], after[i] = -1, none, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n:
                    ranks[left] = rank((parts[left], parts[right]), none)
                    if ranks[left] < none:
                        heapq.heappush(heap, (ranks[left], left))
                elif left >= 0:
                    ranks[left] = none
        return tuple(x for x in parts if x >= 0)

    def frequent(self) -> Iterable[bytes]:
        """The words that the vocabulary spells in one token."""
        back = {c: i for i, c in enumerate(self.letters)}
        return (bytes(back[c] for c in x[: -len(self.suffix)]) for x in self.ids if self.suffix and x.endswith(self.suffix) and len(x) > len(self.suffix))


def words(text: str) -> list[str]:
    """The words of a text without special tokens, normalised."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower case goes letter by letter: no form for the end of a word
        text = text.replace("Σ", "σ")
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ANY.findall(text.translate(LOWER) if LOWERED.search(text) else text)
    return LATIN.findall(text)


class Encoder:
    def __init__(self, model: Model, lexicon: Lexicon, memo: int = MEMO) -> None:
        self.model, self.lexicon, self.memo, self.seen = model, lexicon, memo, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8")
        ids = self.lexicon.get(raw)
        if ids is None:
            ids = self.model.merge(raw)
        self.seen[word] = ids
        return ids

    def _plain(self, text: str) -> Iterator[tuple[int, ...]]:
        found = words(text)
        if len(self.seen) > self.memo:
            self.seen.clear()
        seen = self.seen
        for word in set(found).difference(seen):
            self.of_word(word)
        return map(seen.__getitem__, found)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.model.split is None or not any(x in text for x in self.model.special):
            return np.fromiter(chain.from_iterable(self._plain(text)), np.int32)
        parts = [list(self._plain(x)) if i % 2 == 0 else [(self.model.special[x],)] for i, x in enumerate(self.model.split.split(text))]
        return np.fromiter(chain.from_iterable(chain.from_iterable(parts)), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.model.tokens.__getitem__, ids))


def compiled(model: Model, more: Iterable[str] = ()) -> bytes:
    chosen = {x for x in chain(model.frequent(), (x.encode("utf-8") for x in more)) if x}
    return compile_lexicon((x, model.merge(x)) for x in chosen)


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, more_words: Iterable[str] = (), decode: bool = True
) -> DataFrame:
    """doc_id, ids (array of int) and, if asked for, decoded (the text that those ids spell), one row per input row.

    tokenizer: path of the tokenizer file, read by the driver alone; more_words: further words for the lexicon. A map over rows."""
    sc = docs.sparkSession.sparkContext
    model = Model(tokenizer)
    data = compiled(model, more_words)
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    if not any(str(x).endswith(name) for x in sc.listFiles):
        sc.addFile(C.shared_file(docs.sparkSession, name, data))  # Spark gives each executor a copy of its own to map
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _open:
            _open[name] = Lexicon(SparkFiles.get(name))
        encoder = Encoder(shared.value, _open[name])
        for batch in batches:
            for lo, hi in C.chunks(C.text_bytes(batch.column(1))[1], 8_000_000):
                found = [encoder.encode(x.as_py()) for x in batch.column(1).slice(lo, hi - lo)]
                at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                columns = [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))]
                columns += [pa.array([encoder.decode(x.tolist()) for x in found])] if decode else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(C.load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
