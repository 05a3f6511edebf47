"""BPE encoding and decoding in batched numpy merge rounds.

Words of many documents lie in one flat symbol array. Each round finds the rank of every
adjacent pair by binary search over the sorted pair keys, takes the lowest of each word,
and merges all its occurrences from left to right; words without a pair leave the array.
A bounded memo keeps what was found for words already seen.

The vocabulary file is a parameter. Its normalizer (NFC, lower case), its split pattern and
its byte alphabet are applied here; texts are whole, never prefixes.

Defined cases: a null or empty text has no ids and decodes to an empty text; special token
strings in a text are their own ids, as the file marks them; words of any length are
encoded whole; repeated rows and null ids pass through; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Words that a worker keeps; texts that it handles at once, in code points.
MEMO_WORDS, CHUNK_CHARS = 200_000, 1_000_000
#: Fixed value: the split pattern of this vocabulary, white space spelled out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x20\x85\xa0  -     　\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """The vocabulary, its pair table and the memo of one worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.token) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), merged[order]
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.words = regex.compile(SPLIT)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.ids_of = {t: str(i) for t, i in self.special.items()}
        self.text_of = {t: t for t in self.special}

    def pretokens(self, text: str) -> list[str]:
        if self.split_special and any(t in text for t in self.special):
            parts = self.split_special.split(text)
            return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._segment(p))]
        return self._segment(text)

    def _segment(self, text: str) -> list[str]:
        # lower() would write a word-final sigma differently; the vocabulary's rule is by character
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, by merge rounds over all of them."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        length = np.array([len(r) for r in raw])
        ends = np.cumsum(length)
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), length)
        done_sym, done_word = [], []
        none = len(self.keys)
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.full(len(sym), none)
            found = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][found] = self.rank[at[found]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = least == none
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = np.flatnonzero((rank == least) & ~over)
            # of overlapping occurrences (aaa) every second one counts, from the left
            if len(hit):
                run = np.r_[True, np.diff(hit) != 1]
                nth = np.arange(len(hit)) - np.repeat(np.flatnonzero(run), np.diff(np.r_[np.flatnonzero(run), len(hit)]))
                hit = hit[nth % 2 == 0]
                sym = sym.copy()
                sym[hit] = self.merged[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.split(sym[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids_of]
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            for w, ids in zip(part, self.merge(part), strict=True):
                ids = ids.tolist()
                self.ids_of[w] = " ".join(map(str, ids))
                self.text_of[w] = " ".join(map(self.token.__getitem__, ids))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids, decoded) of each text: ids in decimal, decoded as their tokens, both joined by a space."""
        if len(self.ids_of) > MEMO_WORDS:
            self._forget()
        split = [self.pretokens(t) for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield " ".join(map(self.ids_of.__getitem__, words)), " ".join(map(self.text_of.__getitem__, words))


def decode(ids: str, bpe: WordBpe) -> str:
    """Tokens of decimal ids; this vocabulary has no decoder, so they stay as they are."""
    return " ".join(bpe.token[int(i)] for i in ids.split())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, path: str | None = None, keep_texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for (doc_id, text); with ``keep_texts``
    also the ids and the decoded text themselves."""
    extra = [pa.field("ids", pa.string()), pa.field("decoded", pa.string())] if keep_texts else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path or default_vocabulary())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            ids, texts, rows, size = batch.column(0), batch.column(1), [], 0
            held: list[str] = []
            for k in range(batch.num_rows + 1):
                if held and (k == batch.num_rows or size > CHUNK_CHARS):
                    for a, b in bpe.encode_batch(held):
                        rows.append((a.count(" ") + 1 if a else 0, sha(a), sha(b), *((a, b) if keep_texts else ())))
                    held, size = [], 0
                if k < batch.num_rows:
                    held.append(texts[k].as_py() or "")
                    size += len(held[-1])
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if keep_texts else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe_round_trip": op10_bpe_round_trip}
