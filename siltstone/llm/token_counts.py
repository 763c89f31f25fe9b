"""Token counts of texts over a merge vocabulary, with a shortcut for whole tokens.

The proof comes first, once for a vocabulary and without any text: every string
of the vocabulary goes through its own merges, and those that end as one symbol
are whole tokens.  Merging sees nothing but the pre-token itself, so a pre-token
equal to such a string counts one wherever it stands.  Texts are cut into
pre-tokens, those in the proven table are counted directly and only the rest is
merged, by rank and then from the left.

Vocabularies of the tokenizers library (``.json``, merges over bytes) are cut by
the library's own normalizer and pre-tokenizer, word by word: neither looks
beyond white space (the vocabulary's settings are checked for that), so a task
keeps the counts of the words that it has met.  Special strings within a text
are one token each, as the library has it.  Vocabularies of sentencepiece
(``.model``, merge type) are cut before word boundaries, see ``pieces``.

Defined cases: a null or empty text has no bytes and no tokens; rows are
independent, so ties, repeated rows and null keys need no rule; other columns
are not read; an empty table gives an empty table.  Texts are taken whole.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm import pieces

KEPT_WORDS = 500_000  # words whose counts a task keeps; speed only
KEPT_BYTES = 64  # longer words are not kept
BATCH_BYTES = 1 << 20
SHORT = 48  # symbols up to which all pairs are looked through
NEVER = 1 << 60
# How the tokenizers library names its parts, and white space as its patterns have it.
CONTEXT_FREE = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
SPACE_FOLDING = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no pair of neighbours has a rank any more."""
    n = len(symbols)
    if n <= SHORT:
        return _short_merged_length(symbols, ranks)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(r, i, i + 1, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
    heapq.heapify(waiting)
    symbols, left_over = list(symbols), n
    while waiting:
        _, left, right, pair = heapq.heappop(waiting)
        if symbols[left] != pair[0] or after[left] != right or symbols[right] != pair[1]:
            continue  # one of the two has been merged since
        symbols[left], symbols[right] = pair[0] + pair[1], ""
        left_over -= 1
        behind = after[left] = after[right]
        ahead = before[left]
        if behind < n:
            before[behind] = left
        for a, b in ((ahead, left), (left, behind)):
            if 0 <= a and b < n and (r := ranks.get(new := (symbols[a], symbols[b]))) is not None:
                heapq.heappush(waiting, (r, a, b, new))
    return left_over


def _short_merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The same for few symbols, where looking through all pairs is quicker than an agenda."""
    rank = ranks.get
    waiting = [rank(pair, NEVER) for pair in zip(symbols, symbols[1:])]
    symbols = list(symbols)
    while waiting and (best := min(waiting)) != NEVER:
        at = waiting.index(best)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        del waiting[at]
        if at:
            waiting[at - 1] = rank((symbols[at - 1], symbols[at]), NEVER)
        if at < len(waiting):
            waiting[at] = rank((symbols[at], symbols[at + 1]), NEVER)
    return len(symbols)


class WordVocabulary:
    """A byte-level merge vocabulary of the tokenizers library, as its file states it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only merge vocabularies without dropout and prefixes are counted")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocabulary = model["vocab"].keys()
        self.taken_whole = bool(model.get("ignore_merges"))
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.by_word = self._sees_no_further_than_a_word(stated)
        special = stated.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].split() for t in special):
            raise ValueError("special strings that depend on their surroundings are not counted")
        strings = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None

    @staticmethod
    def _sees_no_further_than_a_word(stated: dict) -> bool:
        """Whether the normalizer works sign by sign and the pre-tokenizer drops white space."""
        normal = stated.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = normal.get("normalizers", [normal])
        cutter = stated["pre_tokenizer"]
        first = cutter.get("pretokenizers", [cutter])[0]
        drops = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"]
        # A match must not hold white space: no alternative may name it but to shut it out.
        inside = first.get("pattern", {}).get("Regex", "\\s").replace("[^\\s", "[^")
        names_space = re.search(r"\\[sSWDRX]|\[\^(?!\\p\{L\}\\p\{N\}\])|\s|(?<!\\)\.", inside)
        return drops and not names_space and all(s["type"] in CONTEXT_FREE or s == SPACE_FOLDING for s in steps)

    def symbols(self, piece: str) -> list[str]:
        return [*piece[:-1], piece[-1] + self.suffix]

    def proven(self) -> frozenset[str]:
        """The pre-tokens that are one token: strings of the vocabulary that merge into themselves."""
        whole = (v.removesuffix(self.suffix) if self.suffix else v for v in self.vocabulary if v.endswith(self.suffix) and v != self.suffix)
        return frozenset(p for p in whole if self.taken_whole or merged_length(self.symbols(p), self.ranks) == 1)


class _Counter:
    """Counts the tokens of texts from the counts of their parts, which a task keeps; one per task."""

    def __init__(self):
        self.kept: dict = {}

    def parts(self, text: bytes) -> list:
        raise NotImplementedError

    def count(self, parts: list) -> list[int]:
        raise NotImplementedError

    def __call__(self, texts: list[bytes]) -> list[int]:
        cut = [self.parts(t) for t in texts]
        fresh = list(set().union(*cut).difference(self.kept))
        kept = self.kept
        kept.update(zip(fresh, self.count(fresh), strict=True))
        totals = [sum(map(kept.__getitem__, parts)) for parts in cut]
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for part in fresh:
            if len(part) > KEPT_BYTES:
                kept.pop(part, None)
        return totals


class WordCounter(_Counter):
    """Over a vocabulary of the tokenizers library."""

    def __init__(self, path: str, proven: frozenset[str]):
        from tokenizers import Tokenizer

        super().__init__()
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer, library.pre_tokenizer
        self.stated, self.proven = WordVocabulary(path), proven
        # Where words are no parts of their own, the counts of pre-tokens are kept instead.
        self.of_piece = self._of_piece if self.stated.by_word else lru_cache(maxsize=KEPT_WORDS)(self._of_piece)

    def parts(self, text: bytes) -> list[bytes]:
        # bytes.split parts at the six ASCII spaces alone, which every pattern of the library drops as well.
        return text.split() if self.stated.by_word else [text]

    def count(self, parts: list[bytes]) -> list[int]:
        """Many words are normalized and cut in one call; those that hold a special string one by one."""
        texts = [p.decode() for p in parts]
        special = self.stated.special
        if not self.stated.by_word or not special:
            return [self.pieces_of(t) for t in texts]
        totals = [0] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if special.search(text):
                totals[i] = self.pieces_of(text)
            else:
                plain.append(i)
        normal = self._normal(" ".join([texts[i] for i in plain]))
        ends, at = [], -1
        for word in normal.split(" "):
            at += len(word) + 1
            ends.append(at)
        if len(ends) != len(plain):  # a word that normalizes to white space, or to none
            for i in plain:
                totals[i] = self.pieces_of(texts[i])
            return totals
        k = 0
        for piece, (first, _) in self.cut.pre_tokenize_str(normal):
            while first >= ends[k]:
                k += 1
            totals[plain[k]] += self._of_piece(piece)
        return totals

    def _normal(self, text: str) -> str:
        return self.normal.normalize_str(text) if self.normal else text

    def _of_piece(self, piece: str) -> int:
        return 1 if piece in self.proven else merged_length(self.stated.symbols(piece), self.stated.ranks)

    def pieces_of(self, text: str) -> int:
        special = self.stated.special
        parts = special.split(text) if special else [text]
        cut = (self.cut.pre_tokenize_str(self._normal(p)) for p in parts if p)
        return len(parts) - 1 + sum(self.of_piece(piece) for pieces_ in cut for piece, _ in pieces_)


def proven_segments(model: str) -> frozenset[str]:
    """The segments of a sentencepiece vocabulary that are one token."""
    own = pieces.encoder(model)
    return frozenset(p for p in own.pieces if p.startswith(pieces.BOUNDARY) and len(own.merge(p)) == 1)


class SegmentCounter(_Counter):
    """Over a merge vocabulary of sentencepiece."""

    def __init__(self, model: str, proven: frozenset[str]):
        super().__init__()
        self.own, self.proven = pieces.encoder(model), proven

    def parts(self, text: bytes) -> list[str]:
        return pieces._SEGMENT.findall(pieces.BOUNDARY + text.decode().replace(" ", pieces.BOUNDARY)) if text else []

    def count(self, parts: list[str]) -> list[int]:
        rest = [p for p in parts if p not in self.proven]
        merged = dict(zip(rest, self.own.merge_all(rest), strict=True))
        return [len(merged[p]) // 4 if p in merged else 1 for p in parts]


def prove(path: str) -> frozenset[str]:
    """The whole-token table of a vocabulary file; it is as large as the vocabulary at most."""
    return proven_segments(path) if path.endswith(".model") else WordVocabulary(path).proven()


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", proven: Iterable[str] | None = None) -> DataFrame:
    """``key, n_bytes, n_tokens`` of each row of ``docs``.

    ``path`` is a vocabulary file that every executor has; ``proven`` is the
    result of ``prove`` for it, made here where it is not given.
    """
    whole = frozenset(proven) if proven is not None else prove(path)
    shipped = docs.sparkSession.sparkContext.broadcast(whole)
    counter = SegmentCounter if path.endswith(".model") else WordCounter
    kind = docs.select(key).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches):
        count = counter(path, shipped.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            sizes, tokens, first = [], [], 0
            while first < len(texts):
                part, held = [], 0
                while first + len(part) < len(texts) and held < BATCH_BYTES:
                    part.append(texts[first + len(part)].as_py() or b"")
                    held += len(part[-1])
                sizes += map(len, part)
                tokens += count(part)
                first += len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], [key, "n_bytes", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"{kind}, n_bytes bigint, n_tokens bigint")
