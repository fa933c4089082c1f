"""Quality rules: counts of the text itself, and tokeniser fertility under public vocabularies.

Fertility is measured on words: every word of a text is encoded as it stands after a
space, by each vocabulary, and a text's tokens are those of its words.  A worker
encodes a word once and keeps its tokens, so the cost is that of the distinct words.  Per vocabulary:

* chars_per_token - code points of words per token;
* fallback_share  - tokens that are no whole characters: byte pieces of a vocabulary
  with byte fallback, pieces that end inside a character in a byte-level one;
* token_entropy   - Shannon entropy of the text's tokens, in bits.

A band of a language (column lang) or, for languages without one, of the script most
of the text's letters belong to, says what is accepted; the limits of
token_entropy hold from ENTROPY_TOKENS tokens on, as a short text can't reach them.

Defined cases: null, empty and blank texts have no words, all counts 0, measures null
and fail the base rule; a null or unknown lang falls back to the script, an unknown script
to the widest band; repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored by `measured` and kept by `accepted`.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import chunks, env_path, mapped

#: Where the public vocabulary files are.
VOCABULARIES = env_path("QUARRYKIT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENTROPY_TOKENS = 64
#: Distinct words whose tokens a worker keeps before it starts anew.
KEPT_WORDS = 200_000


@dataclass(frozen=True)
class Band:
    """Accepted ranges, of the byte-level vocabulary and of the one with byte fallback."""

    chars_per_token: tuple[float, float]
    piece_chars_per_token: tuple[float, float]
    fallback_share: float
    token_entropy: float


#: By language, then by script. The lower ends lie well under natural prose and over runs of symbols, codes or capitals.
BANDS = {
    "en": Band((1.7, 9.0), (1.7, 9.0), 0.20, 3.0), "de": Band((1.6, 9.0), (1.6, 9.0), 0.20, 3.0), "fr": Band((1.6, 9.0), (1.6, 9.0), 0.20, 3.0), "es": Band((1.6, 9.0), (1.6, 9.0), 0.20, 3.0),
    "latin": Band((1.5, 10.0), (1.5, 10.0), 0.25, 3.0), "cyrillic": Band((0.8, 10.0), (0.8, 10.0), 0.40, 3.0), "greek": Band((0.6, 10.0), (0.6, 10.0), 0.50, 3.0),
    "han": Band((0.3, 6.0), (0.3, 6.0), 0.98, 2.0), "other": Band((0.2, 12.0), (0.2, 12.0), 1.0, 2.0),
}
_SCRIPTS = {"latin": re.compile(r"[A-Za-zÀ-ɏ]"), "cyrillic": re.compile(r"[Ѐ-ԯ]"), "greek": re.compile(r"[Ͱ-Ͽ]"), "han": re.compile(r"[぀-ヿ㐀-鿿가-힯]")}
_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_CONTINUATION = bytes(range(0x80, 0xC0))


class BytePairs:
    """A byte-level vocabulary of ranks."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        with open(f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding(name, pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.partial = np.zeros(max(ranks.values()) + 1, bool)
        for piece, i in ranks.items():
            try:
                piece.decode("utf-8")
            except UnicodeDecodeError:
                self.partial[i] = True

    def encode(self, words: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + w) for w in words]


class Pieces:
    """A sentence-piece vocabulary with byte fallback."""

    def __init__(self, folder: str, name: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")
        self.partial = np.array([self.coder.is_byte(i) for i in range(self.coder.get_piece_size())])

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.coder.encode(words, num_threads=1)


_loaded: dict[str, tuple] = {}


def vocabularies(folder: str) -> tuple:
    if folder not in _loaded:
        _loaded[folder] = (BytePairs(folder, "byte_bpe_multi_50k.tiktoken"), Pieces(folder, "piece_bpe_32k.model"))
    return _loaded[folder]


class Lexicon:
    """Words by number, with their code points and each vocabulary's tokens."""

    def __init__(self, coders: tuple):
        self.coders = coders
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.chars = np.zeros(0, np.int64)
        self.tokens = [np.zeros(0, np.int32) for _ in self.coders]
        self.first = [np.zeros(1, np.int64) for _ in self.coders]

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > KEPT_WORDS:
            self.clear()
        known, get = len(self.number), self.number.setdefault
        out = [np.fromiter((get(w, len(self.number)) for w in words), np.int64, len(words)) for words in texts]
        new = [w.decode("utf-8", "replace") for w in list(self.number)[known:]]
        if new:
            self.chars = np.concatenate((self.chars, np.fromiter(map(len, new), np.int64, len(new))))
            for i, coder in enumerate(self.coders):
                rows = coder.encode(new)
                lens = np.fromiter(map(len, rows), np.int64, len(rows))
                self.tokens[i] = np.concatenate((self.tokens[i], np.fromiter((t for r in rows for t in r), np.int32, int(lens.sum()))))
                self.first[i] = np.concatenate((self.first[i], self.first[i][-1] + np.cumsum(lens)))
        return out

    def measures(self, i: int, words: np.ndarray) -> tuple[float | None, float | None, float | None, int]:
        """chars_per_token, fallback_share, token_entropy, tokens of a text's words under vocabulary i."""
        starts, lens = self.first[i][words], self.first[i][words + 1] - self.first[i][words]
        total = int(lens.sum())
        if not total:
            return None, None, None, 0
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(total)
        tokens = np.sort(self.tokens[i][at])
        edges = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
        counts = np.diff(np.concatenate(([0], edges, [total])))
        entropy = float(np.log2(total) - (counts * np.log2(counts)).sum() / total)
        return float(self.chars[words].sum() / total), float(self.coders[i].partial[tokens].mean()), max(0.0, entropy), total


def repeated_words(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur more than once."""
    n = len(words) - 2
    if n < 2:
        return 0
    _, pair = np.unique(words[:-1] * (int(words.max()) + 1) + words[1:], return_inverse=True)
    _, back, counts = np.unique(pair[:n] * (int(words.max()) + 1) + words[2:], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[back] > 1)
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[hit + i] = True
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    found = {name: len(p.findall(text)) for name, p in _SCRIPTS.items()}
    best = max(found, key=found.get)
    return best if found[best] else "other"


def band_of(lang: str | None, text: bytes) -> Band:
    return BANDS[lang] if lang in BANDS and len(lang) == 2 else BANDS[script(text.decode("utf-8", "replace"))]


def within(band: Band, byte_level: tuple, pieces: tuple) -> bool:
    if byte_level[0] is None or pieces[0] is None:
        return False
    a, b = band.chars_per_token, band.piece_chars_per_token
    ok = a[0] <= byte_level[0] <= a[1] and b[0] <= pieces[0] <= b[1] and pieces[1] <= band.fallback_share
    return ok and (byte_level[3] < ENTROPY_TOKENS or byte_level[2] >= band.token_entropy)


FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("chars_per_token", pa.float64()), ("piece_chars_per_token", pa.float64()), ("partial_share", pa.float64()), ("fallback_share", pa.float64()), ("token_entropy", pa.float64()), ("piece_entropy", pa.float64()),
]


def judged(lexicon: Lexicon, texts: list[bytes], langs: list[str | None]) -> list[tuple]:
    """A tuple of FIELDS for each text."""
    out = []
    for text, lang, words in zip(texts, langs, lexicon.numbers([t.split() for t in texts]), strict=True):
        n = len(words)
        repeats = repeated_words(words)
        failed = n < 50 or 100 * repeats > 50 * n
        a, b = (lexicon.measures(i, words) for i in (0, 1))
        kept = not failed and within(band_of(lang, text), a, b)
        out.append((n, int(lexicon.chars[words].sum()), len(text.translate(None, _SYMBOLS)), duplicate_lines(text), repeats, failed, kept, a[0], b[0], a[1], b[1], a[2], b[2]))
    return out


def _judge(folder: str):
    """batches of (..., text, lang) by name -> (slice of a batch, its judgements)."""

    def run(batches):
        lexicon = Lexicon(vocabularies(folder))
        for batch, texts in chunks(batches):
            yield batch, judged(lexicon, texts, batch.column(batch.schema.get_field_index("lang")).to_pylist())

    return run


def measured(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """doc_id and FIELDS of every row of docs (doc_id, text, lang)."""
    judge = _judge(folder)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), *FIELDS])
        for batch, rows in judge(batches):
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f[1]) for c, f in zip(columns, FIELDS, strict=True))], schema=schema)

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), run, ", ".join(["doc_id long", *(f"{n} {kinds[t]}" for n, t in FIELDS)]))


def accepted(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """The documents that pass; columns and their order are those of docs, and nothing is shuffled."""
    judge = _judge(folder)

    def run(batches):
        for batch, rows in judge(batches):
            yield batch.filter(pa.array([r[6] for r in rows], pa.bool_()))

    return mapped(docs, run, docs.schema)
