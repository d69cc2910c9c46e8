"""SentencePiece encoding and decoding of merge-type (BPE) models, exact.

A sequence of pieces is what the merges give if and only if every two neighbours are: merging their
joined text again must give just these two. So the encoder walks the text with Aho-Corasick longest
matches, checks each piece against the one before by merging both again (kept in a table), falls
back to shorter pieces, and marks positions from which no valid rest exists in a bitfield, which
bounds the backtracking.

Texts are cut where no piece of the model can cross: between two characters that stand side by side
in no piece. What a part encodes to is therefore independent of the rest. Each Python worker keeps
the ids of words it has met in two generations of at most KEPT_WORDS words: when the younger is full
it becomes the older one, and words that are met again move over, so common words stay. A kept word
has been decoded from its ids once; only words that decode to something else keep that text, too.

Edge cases: null texts count as empty and have no ids; any text is handled whole; characters that
the model lacks become bytes; repeated rows are encoded alike; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, per_text
from .hashing import slices

SPACE = "▁"
KEPT_WORDS = 200_000
KEPT_PAIRS = 500_000
#: Longer words are not kept, so that a table's bytes are bounded with its words.
KEPT_LENGTH = 48
#: Between a kept word's ids and the text that these decode to, where it is not the word's own.
DECODED = "\0"
NO_MERGE = float("-inf")


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        count = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(count)]
        self.decimals = [str(i) for i in range(count)]
        normal = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.id_of = {self.pieces[i]: i for i in normal}
        self.score = {self.pieces[i]: model.get_score(i) for i in normal}
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(count) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i in range(count) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.special = self.silent | set(self.byte_of) | {self.unknown}
        self.longest = max(map(len, self.id_of))
        self.joined = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        valid = {p for p in self.id_of if self.merged(p) == [p]}  # no merges lead to the others
        for p in valid:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        #: Each piece and the shorter ones that it starts with, longest first; its first character may be no piece.
        self.choices = {p: [p, *(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in valid)] for p in valid}
        self.parts_of = self.part_pattern().findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.passing: list[str] = []

    def part_pattern(self) -> re.Pattern:
        """Cuts a text where no piece crosses: before spaces, and between letters and what no piece joins to letters."""
        mixed = {c for pair in self.joined for c in pair if SPACE not in pair and pair[0].isalpha() != pair[1].isalpha() and not c.isalpha()}
        if any(pair[1] == SPACE != pair[0] for pair in self.joined):
            return re.compile(r"(?s).+")
        glue = "".join(map(re.escape, sorted(mixed)))
        odd = "".join(map(re.escape, sorted(c for c in {x for p in self.joined for x in p} if c.isalpha() and not re.match(r"[^\W\d_]", c))))
        letter = rf"(?:[^\W\d_]|[{glue}{odd}])" if glue or odd else r"[^\W\d_]"
        return re.compile(rf"{SPACE}*{letter}+|{SPACE}*(?:(?!{letter})[^{SPACE}])+|{SPACE}+", re.S)

    def merged(self, text: str) -> list[str]:
        """The merges themselves: the best-scored neighbours first, the leftmost of equals. For short texts."""
        symbols, get = list(text), self.score.get
        scores = [get(x + y, NO_MERGE) for x, y in pairwise(symbols)]
        while scores and (best := max(scores)) > NO_MERGE:
            k = scores.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(symbols[k - 1] + symbols[k], NO_MERGE)
            if k < len(scores):
                scores[k] = get(symbols[k] + symbols[k + 1], NO_MERGE)
        return symbols

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = left[-1] + right[0] not in self.joined or self.merged(left + right) == [left, right]
        return known

    def longest_at(self, text: str, at: int) -> list[str] | str:
        """The longest match of a piece at a place, then the shorter ones that it starts with."""
        choices_of, n = self.choices.get, self.automaton.longest_prefix(text[at : at + self.longest])
        while n > 1:
            found = choices_of(text[at : at + n])
            if found is not None:
                return found
            n -= 1
        return text[at]

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a part, found from longest matches with backtracking."""
        at, n, pairs, longest_at = 0, len(text), self.pairs.get, self.longest_at
        failed = None  # a bit for each place from which no rest exists
        out, tried, left = [], [], None
        choices = iter(longest_at(text, 0))
        while True:
            for piece in choices:
                to = at + len(piece)
                if failed is not None and failed[to >> 3] >> (to & 7) & 1:
                    continue
                if left is not None:
                    fits = pairs((left, piece))
                    if not (self.compatible(left, piece) if fits is None else fits):
                        continue
                out.append(piece)
                if to == n:
                    return out
                tried.append(choices)
                at, left = to, piece
                choices = iter(longest_at(text, at))
                break
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(out.pop())
                left = out[-1] if out else None
                choices = tried.pop()

    def text_ids(self, part: str) -> list[int]:
        pieces = self.backtracked(part)
        found = list(map(self.id_of.get, pieces))
        if None not in found:
            return found
        out: list[int] = []
        for i, piece in zip(found, pieces, strict=True):
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts_of(SPACE + text.replace(" ", SPACE)) for i in self.text_ids(part)] if text else []

    def decode(self, ids: list[int], start: bool = True) -> str:
        """The text of ids. start: the first piece's leading space is the one that encoding adds."""
        if self.special.isdisjoint(ids):
            text = "".join(map(self.pieces.__getitem__, ids)).replace(SPACE, " ")
            return text[1:] if start and text.startswith(" ") else text
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(replaced(bytes(run)))
                run.clear()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(replaced(bytes(run)))
        text = "".join(out)
        return text[1:] if start and ids and self.pieces[ids[0]].startswith(SPACE) else text

    def part(self, part: str) -> str:
        """A part's ids as decimals, and what they decode to if it is not the part.

        Kept under the word if it is a space and a word, else under a space and the part, which is no word.
        """
        key = part[1:] if part[0] == SPACE and SPACE not in part[1:] and len(part) > 1 else " " + part
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                ids = self.text_ids(part)
                found, decoded = ",".join([self.decimals[i] for i in ids]), self.decode(ids, start=False)
                if decoded != part.replace(SPACE, " "):
                    found += DECODED + decoded
            self.young[key] = found
            if len(key) > KEPT_LENGTH:
                self.passing.append(key)
        return found

    def learn(self, words: set[str]) -> None:
        """Gives the young table the same for spaces and words without spaces."""
        young, get, parts_of = self.young, self.old.get, self.parts_of
        for word in [w for w in words if w not in young]:
            found = get(word)
            if found is None:
                parts = parts_of(SPACE + word)
                if len(parts) == 1:
                    self.part(parts[0])
                    continue
                found = joined(list(map(self.part, parts)), parts)
            young[word] = found
            if len(word) > KEPT_LENGTH:
                self.passing.append(word)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the count of ids, and SHA-256 of the ids and of the decoded text."""
        # spaces in a row may be one piece, so such texts are cut as a whole
        words = [None if "  " in t or t[:1] == " " or t[-1:] == " " or SPACE in t else t.split(" ") for t in texts]
        self.learn(set().union(*(w for w in words if w is not None)))
        known = self.young.__getitem__
        for text, own in zip(texts, words, strict=True):
            if not text:
                yield 0, sha(""), sha("")
                continue
            if own is None:
                parts = self.parts_of(SPACE + text.replace(" ", SPACE))
                found = joined(list(map(self.part, parts)), parts)
            else:
                found = joined(list(map(known, own)), own, " ")
            ids, other, decoded = found.partition(DECODED)
            if not other:
                decoded = " " + text.replace(SPACE, " ")
            yield ids.count(",") + 1, sha(ids), sha(decoded[1:] if decoded.startswith(" ") else decoded)
        for key in self.passing:
            self.young.pop(key, None)
        self.passing.clear()
        if len(self.young) >= KEPT_WORDS:
            self.young, self.old = {}, self.young


def joined(known: list[str], texts: list[str], before: str = "") -> str:
    """Ids of all parts, or words with what stands before each, and what they decode to if that is not their text."""
    out = ",".join(known)
    if DECODED not in out:
        return out
    cut = [k.partition(DECODED) for k in known]
    return ",".join([ids for ids, _, _ in cut]) + DECODED + "".join([d if other else before + t.replace(SPACE, " ") for (_, other, d), t in zip(cut, texts, strict=True)])


def replaced(run: bytes) -> str:
    """Bytes as text; each byte that starts no character becomes U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, k = [], 0
    while k < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def codec(model_file: str) -> PieceCodec:
    return held(f"pieces {model_file}", lambda: PieceCodec(model_file))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text. model_file is on every executor."""


    def columns(texts: list[str]):
        own = codec(model_file)
        rows = [row for a, b in slices([t.encode() for t in texts]) for row in own.digests(texts[a:b])]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]

    return per_text(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns, holds=f"pieces {model_file}")


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the ids themselves."""
    return per_text(docs, "ids array<int>", lambda texts: [[codec(model_file).encode(t) for t in texts]], holds=f"pieces {model_file}")


def decoded(ids: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the text of its ids."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = pa.array([codec(model_file).decode(i or []) for i in b.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
