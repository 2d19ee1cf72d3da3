"""Encoding and decoding with merge-type sentencepiece vocabularies, by a score-ordered agenda of adjacent pairs.

No piece has the space mark after another character, so no merge crosses the end of a word (with the space marks before
it); where no piece holds a letter beside another character, none crosses from letters to others either. Texts are
encoded by such segments, each distinct one once as long as the cache holds it. What the agenda makes is checked in every
Arrow batch against the library, ids and decoded text alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import sentencepiece
from pyspark.sql import DataFrame

from formline.llm.common import map_batches, sliced, text_columns
from formline.llm.memo import Memo

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Segments that one call of the library checks.
CHECKED = 400


def segments(vocabulary: Iterable[str]) -> re.Pattern[str]:
    """Words cut where letters meet other characters. A cut depends on the two characters beside it alone, so if every
    piece is one segment, no merge crosses a cut; else words stay whole."""
    numerals = "".join(sorted({c for p in vocabulary for c in p if c.isalnum() and not c.isalpha()}))
    pattern = re.compile(rf"{MARK}*(?:[^\W\d_{numerals}]+|(?:(?!{MARK})[\W\d_{numerals}])+)|{MARK}+")
    return pattern if all(map(pattern.fullmatch, vocabulary)) else WORD


class PieceModel:
    """Vocabulary, agenda and caches of one model file."""

    def __init__(self, path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.id_of = {sp.id_to_piece(i): i for i in ids if i not in special}
        #: The agenda's order: highest score first, then leftmost.
        self.cost = {p: -sp.get_score(i) for p, i in self.id_of.items()}
        self.byte_of = {int(sp.id_to_piece(i)[3:-1], 16): i for i in ids if sp.is_byte(i)}
        self.surface = {i: p.replace(MARK, " ").encode() for p, i in self.id_of.items()} | {i: bytes([b]) for b, i in self.byte_of.items()}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("pieces that hold a space mark inside cannot be encoded word by word")
        self.segment = segments(self.id_of)
        self.unchecked: list[tuple[str, list[int]]] = []
        self.memo = Memo(self.encode_word)

    def merge(self, word: str) -> list[str]:
        """Merge the adjacent pair of the highest score until none is in the vocabulary."""
        parts: list[str | None] = list(word)
        last = len(parts) - 1
        after, before = list(range(1, len(parts) + 1)), list(range(-1, last))
        cost = self.cost
        agenda = [(c, i, p) for i in range(last) if (c := cost.get(p := word[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            if parts[i] is None or j > last or len(parts[i]) + len(parts[j]) != len(piece) or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, None
            after[i] = k = after[j]
            if k <= last:
                before[k] = i
                if (c := cost.get(p := piece + parts[k])) is not None:
                    heappush(agenda, (c, i, p))
            h = before[i]
            if h >= 0 and (c := cost.get(p := parts[h] + piece)) is not None:
                heappush(agenda, (c, h, p))
        return [p for p in parts if p is not None]

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.merge(word):
            i = self.id_of.get(p)
            out.extend([i] if i is not None else [self.byte_of[b] for b in p.encode()])
        return out

    def encode_word(self, word: str) -> tuple[str, bytes]:
        """Ids as decimals joined by commas, and the decoded bytes."""
        ids = self.ids(word)
        self.unchecked.append((word, ids))
        return ",".join(map(str, ids)), b"".join([self.surface[i] for i in ids])

    def words(self, text: str) -> list[str]:
        return self.segment.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.ids(w)]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")

    def agrees(self, words: list[tuple[str, list[int]]]) -> bool:
        """Whether the library gives these ids, and decodes them to these words, where they stand in one text."""
        text, ids = [], []
        for word, own in words:
            if word[0] != MARK:
                # Something of the other class before it, so that the text is cut there.
                lead = f"{MARK}." if self.segment.fullmatch(f"a{word}") else f"{MARK}a"
                text.append(lead)
                ids += self.ids(lead)
            text.append(word)
            ids += own
        whole = "".join(text)[1:].replace(MARK, " ")
        return self.library.encode(whole) == ids and self.library.decode(ids) == whole

    def check(self) -> None:
        """Hold the segments encoded since the last call against the library, many in one text; marks alone would join
        the next segment and are texts of their own. A lone mark stands for a text that ends in a space and has no text
        of its own to compare."""
        fresh, self.unchecked = [x for x in self.unchecked if x[0] != MARK], []
        apart = [[x] for x in fresh if not x[0].strip(MARK)]
        joined = [x for x in fresh if x[0].strip(MARK)]
        for part in [*apart, *(joined[i : i + CHECKED] for i in range(0, len(joined), CHECKED))]:
            if not self.agrees(part):
                wrong = next((w for w, i in part if not self.agrees([(w, i)])), part[0][0])
                raise ValueError(f"the agenda and the library differ on {wrong!r}")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        both = list(map(self.memo.__getitem__, self.words(text or "")))
        ids = ",".join([x[0] for x in both])
        decoded = b"".join([x[1] for x in both])[1:]
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    """One model and its caches for each Python worker."""
    return PieceModel(path)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids themselves, one array per document, and the text decoded from them: key, ids, decoded."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        model = model_at(path)
        for b in sliced(batches, text, 1 << 22):
            ids = [list(map(int, x.split(","))) if (x := ",".join([model.memo[w][0] for w in model.words(t or "")])) else [] for t in b[text]]
            model.check()
            yield {key: b[key], "ids": ids, "decoded": [model.decode(i) for i in ids]}

    return map_batches(text_columns(docs, key, text), run, f"`{key}` bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no ids; repeated rows
    are encoded alike; an empty table gives no rows. A word that differs from the library's result stops the job."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        model = model_at(path)
        for b in sliced(batches, text, 1 << 22):
            n, ids, decoded = zip(*map(model.digest, b[text]), strict=True)
            model.check()
            yield {key: b[key], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_batches(text_columns(docs, key, text), run, f"`{key}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
