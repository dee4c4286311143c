"""Problem 9: text that was decoded with the wrong character encoding.

`garbled_documents` gives the documents with at least one garbled passage, `repaired_documents` also the text with
every passage restored where that is possible.

How: round-trip repair. Every run of non-ASCII characters, and every line and sentence that holds unlikely neighbours, is
re-encoded under each candidate legacy encoding and strictly decoded as the intended encoding (UTF-8 for runs; the
single-byte encodings of Western and Central European, Cyrillic and Greek texts for lines and sentences). A result is accepted
only when the garbling cost drops, on both routes, and the step is repeated for nested layers until nothing changes: a
layer of UTF-8 makes a run shorter, so that ends by itself. Numeric HTML references of non-ASCII characters count as one more
layer. Bytes that were lost (U+FFFD) cannot be restored: such passages are reported and left as they are.

The garbling cost of a text is the sum over all neighbouring characters of which one isn't ASCII of the bits that the pair costs, the
least of three figures: of its share of all documents (`pair_counts`, aggregated by Spark over the whole table), of its use in
the vocabulary of a public multilingual tokenizer, and of the Unicode classes of the two (a letter beside a letter of its
script is cheap in any language, a symbol or another script inside a word is not). A language that the documents hardly hold is
therefore cheap as it stands and gains nothing by being rewritten. Pairs of fewer than one document in 2^16 cost no less
than by their classes, so only more frequent ones are broadcast: at most 2^16 times the distinct pairs of a mean document.

Defined cases: null texts or ids give no row; text within single backticks on one line is quoted and neither judged nor
changed; repeated rows of one document count once.
"""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# fixed values: names of the legacy encodings that are tried, most usual first
LEGACY = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "cp852", "iso8859-15", "cp1254", "cp1257", "cp866", "koi8-r", "iso8859-5")
# fixed values: what a single-byte text was, and what it is read as
WAS = ("cp1252", "cp1250", "iso8859-2", "mac_roman", "cp850", "cp437", "cp1251", "koi8-r", "cp866", "cp1253")
SEEN = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "cp852", "iso8859-15", "cp866", "koi8-r")
SINGLE = tuple((seen, was) for was in WAS for seen in SEEN if seen != was)

_RUN_OF_TWO = re.compile(r"[^\x00-\x7f]{2,}")
_QUOTED = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_ENTITY = re.compile(r"&#(\d{2,7});")
_ENTITIES = re.compile(r"(?:&#\d{2,7};){2,}")
_RUN = re.compile(r"[^\x00-\x7f]+")
_SENTENCE = re.compile(r"[^.!?;:\n]+(?:[.!?;:]+(?!\s)[^.!?;:\n]+)*[.!?;:]*\s*|\n|[.!?;:]+\s*")

# mix-ups without any of these are unusual and need as many bits more
USUAL_PAIR, UNUSUAL = {"cp1252", "latin-1"}, 10.0
_PENALTY = np.array([0.0 if USUAL_PAIR & set(pair) else UNUSUAL for pair in SINGLE])
_ASCII_CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
NO_BREAK = "\u00a0"
# Bits: what a pair costs by its classes. ODD and more never stands in sound words.
LETTERS, EDGE, DIGIT, SIGN, ODD, MIXED, LOST = 6.0, 5.0, 8.0, 6.0, 11.0, 13.0, 16.0
# a pair of fewer bits is usual; a drop of UTF-8 runs; of single bytes with odd pairs; of single bytes that swap letters only
USUAL, RUN_DROP, ODD_DROP, SWAP_DROP, PROOF = 5.0, 2.0, 9.0, 16.0, 16.0
# a context that fewer than one document in this many has is rare
RARE = 64
KEEP, SMOOTH = 0.75, 4096


@lru_cache(100_000)
def _class(c: str) -> tuple[str, str]:
    """(kind, script): kinds are lower, upper, other letter, digit, edge (white space and ASCII marks), open, close, mark
    (dashes, apostrophes and the like), symbol, frame and lost."""
    code, category = ord(c), unicodedata.category(c)
    if c in "ªº":
        return "symbol", ""
    if c == "µ":
        return "unit", ""
    if category[0] in "LM":
        name = unicodedata.name(c, "").split(" ")[0]
        script = "HAN" if name in ("CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "KATAKANA-HIRAGANA") else name
        if name == "COMBINING" or c in "ˈˌː":
            return "accent", ""
        if name == "MODIFIER" or 0x2B0 <= code < 0x300 or 0xFB00 <= code < 0xFB07:
            return "symbol", ""
        return {"Ll": "lower", "Lu": "upper"}.get(category, "letter"), script
    if category == "Nd" or c in "²³¹¼½¾":
        return ("digit" if category == "Nd" else "symbol"), ""
    if c.isspace() or category == "Zs" or code < 0x80 and not c.isalnum():
        return ("edge", "") if code >= 32 or c.isspace() else ("lost", "")
    if category in ("Cc", "Cn", "Co", "Cs") or code == 0xFFFD:
        return "lost", ""
    if 0x2500 <= code < 0x25A0 or 0x25A0 <= code < 0x25E0:
        return "frame", ""
    if c in "„‚¿¡‹":
        return "open", ""
    if c in "…›":
        return "close", ""
    if c in "“”‘’«»–—‑‐·•、。，「」・！？（）：；׳״":
        return "mark", ""
    return ("mark" if category in ("Cf", "Pd", "Po", "Ps", "Pe") and code >= 0x2000 and c not in "‰†‡" else "symbol"), ""


def class_bits(a: str, b: str) -> float:
    """What the pair costs by the classes of its characters."""
    (x, s), (y, t) = _class(a), _class(b)
    if "lost" in (x, y):
        return LOST
    if s and t:
        if s != t and not {s, t} <= {"HAN", "HANGUL", "FULLWIDTH"}:
            return MIXED
        return ODD if x == "lower" and y == "upper" and b not in _ASCII_CAPITALS else LETTERS
    kinds = {x, y}
    word = bool(s or t)
    if "frame" in kinds:
        mixed = x == y and ("\u2550" <= a <= "\u256c") != ("\u2550" <= b <= "\u256c")  # single and double lines
        return DIGIT if word or mixed else 2.0 if x == y else 4.0
    if "symbol" in kinds:
        if word:
            return DIGIT if s and b in "ºª™®©°²³¹" or a in "ºª" else ODD
        return SIGN if x != y or a == b else DIGIT
    if "accent" in kinds:
        return DIGIT if y == "accent" and s or x == "accent" and y != "accent" and a in "ˈˌː" else ODD if y == "accent" and b not in "ˈˌː" else EDGE
    if "unit" in kinds:
        return EDGE if x == "unit" and word else SIGN if not word else ODD
    if "open" in kinds:
        return 9.5 if s and y == "open" else EDGE
    if "close" in kinds:
        return DIGIT if t and x == "close" else EDGE
    if "digit" in kinds and word:
        return DIGIT
    # a single sign of these scripts between spaces is no word
    return ODD if "edge" in kinds and (s or t) in ("HAN", "HANGUL") else EDGE


@lru_cache(100_000)
def _folded(c: str) -> str:
    """The sign under which a character is counted: letters in lower case, digits, white space and ASCII marks as one each,
    scripts of very many letters by their block."""
    code = ord(c)
    if code < 0x80:
        return c.lower() if c.isalpha() else "0" if c.isdigit() else " " if c.isspace() else "."
    if code < 0x530 or 0x1E00 <= code < 0x2600 or 0xFB00 <= code < 0xFB07 or code >= 0xFFF0:
        low = c.lower()
        return low if len(low) == 1 else c
    return chr(code >> 8 << 8) if not 0xD800 <= code >> 8 << 8 < 0xE000 else "가"


@lru_cache(100_000)
def _key(text: str) -> str:
    """The folded signs of two or three neighbours; a capital right after a small letter stays a capital, as that is another case."""
    out = _folded(text[0])
    for a, b in zip(text, text[1:], strict=False):
        out += b if a.islower() and b.isupper() and b not in _ASCII_CAPITALS else _folded(b)
    return out


@lru_cache(4)
def vocabulary_pairs(path: str) -> dict[str, int]:
    """How many tokens of a public tokenizer's vocabulary hold each pair of characters."""
    found: Counter = Counter()
    with open(path, "rb") as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0])
            if token.isascii():
                continue
            try:
                text = token.decode("utf-8")
            except UnicodeDecodeError:
                continue
            found.update({_key(text[k : k + 2]) for k in range(len(text) - 1) if not text[k : k + 2].isascii()})
    # signs counted by their block would make any one of them a word
    return {pair: n for pair, n in found.items() if not (" " in pair and max(pair) >= "\u2e80")}


class Cost:
    """The garbling cost: bits of pairs, from the pairs' shares of all documents, the vocabulary and the classes."""

    def __init__(self, counts: dict[str, int], documents: int, vocabulary: str | None = VOCABULARY):
        self.counts, self.documents = counts, documents
        self.bits = {key: max(1.0, math.log2((documents + SMOOTH) / n)) for key, n in counts.items() if n}
        for pair, n in (vocabulary_pairs(vocabulary) if vocabulary else {}).items():
            self.bits[pair] = min(self.bits.get(pair, LOST), max(2.5, 5 - math.log2(1 + n)))
        self.context = lru_cache(500_000)(self._context)
        self.read_costs = lru_cache(100_000)(self._read_costs)
        self.run_repaired = lru_cache(200_000)(self._run_repaired)

    def _context(self, text: str) -> tuple[float, float, float]:
        """(cost, the dearest pair, the oddest pair by class that isn't usual) of a run with its two neighbours."""
        total = dearest = oddest = 0.0
        for a, b in zip(text, text[1:], strict=False):
            by_class = class_bits(a, b)
            bits = by_class if by_class >= LOST else min(by_class, self.bits.get(_key(a + b), LOST))
            total, dearest = total + bits, max(dearest, bits)
            if bits > USUAL:
                oddest = max(oddest, by_class)
        if len(text) == 3:
            total = min(total, self.bits.get(_key(text), total))
        return total, dearest, oddest

    def of(self, text: str) -> float:
        return 0.0 if text.isascii() else sum(self.context(c)[0] for c in contexts(text))

    def odd(self, text: str) -> float:
        """The bits by class of the oddest pair that isn't usual."""
        return max((self.context(c)[2] for c in contexts(text)), default=0.0)

    def dearest(self, text: str) -> float:
        return max((self.context(c)[1] for c in contexts(text)), default=0.0)

    # --- UTF-8 read as a legacy encoding -----------------------------------------------------------------------------
    def _run_repaired(self, before: str, run: str, after: str) -> tuple[str, int] | None:
        """A run of non-ASCII characters between two neighbours read as UTF-8 under the legacy encoding that gives the
        least cost, nested layers included; None if the cost doesn't drop."""
        best = None
        for legacy in LEGACY:
            data = _encoded(run, legacy)
            if data is None:
                continue
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            text, inner = self.runs_repaired(before + text + after)
            text = text[len(before) : len(text) - len(after)]
            cost = self.of(before + text + after)
            if best is None or cost < best[0]:
                best = (cost, text, 1 + inner)
        if best is None or best[0] > self.of(before + run + after) - RUN_DROP or any(_class(c)[0] == "lost" for c in best[1]):
            return None
        return best[1], best[2]

    def runs_repaired(self, text: str) -> tuple[str, int]:
        """(text with every run repaired, the layers that were undone)."""
        layers = 0

        def one(match: re.Match) -> str:
            nonlocal layers
            fixed = self.run_repaired(text[match.start() - 1] if match.start() else " ", match[0], text[match.end() : match.end() + 1] or " ")
            if fixed is None:
                return match[0]
            layers = max(layers, fixed[1])
            return fixed[0]

        return _RUN_OF_TWO.sub(one, text), layers

    # --- one single-byte encoding read as another ----------------------------------------------------------------------
    def _read_costs(self, context: str) -> np.ndarray:
        """The cost of a context under every single-byte mix-up; infinite where a character can't take part or an odd pair is left."""
        out = np.full(len(SINGLE), np.inf)
        for k, pair in enumerate(SINGLE):
            table = _table(*pair)
            if all(ord(c) in table or c == NO_BREAK or c.isascii() for c in context):
                cost, _, odd = self.context(context.translate(table))
                out[k] = cost if odd < 9 else np.inf
        return out

    def drops(self, text: str) -> np.ndarray:
        """By how much each mix-up lowers the cost of a passage."""
        own = contexts(text)
        return sum(self.context(c)[0] for c in own) - np.sum([self.read_costs(c) for c in own], axis=0) - _PENALTY

    def letters_repaired(self, text: str) -> str | None:
        """The best single-byte mix-up for a passage in which all its non-ASCII characters take part: the cost must drop, by much
        where the passage only swaps letters for letters."""
        before, odd = self.of(text), self.odd(text) >= 9
        least = max(ODD_DROP if odd else SWAP_DROP, (1 - KEEP) * before)
        if before < least:
            return None
        drops = self.drops(text)
        best = int(drops.argmax())
        return text.translate(_table(*SINGLE[best])) if drops[best] >= least else None

    def evidence(self, parts: list[str], table: dict[int, str]) -> float:
        """How much more often, in bits, the documents have the contexts of a reading than those of the text; each context once."""
        own = {c for part in parts for c in contexts(part)}
        return sum(math.log2((self.seen(c.translate(table)) + 1) / (self.seen(c) + 1)) for c in own)

    def seen(self, context: str) -> int:
        keys = [_key(context)] if len(context) == 3 else [_key(context[k : k + 2]) for k in range(len(context) - 1)]
        return min((self.counts.get(x, 0) for x in keys), default=0)

    def together_repaired(self, parts: list[str]) -> dict[str, str]:
        """What one mix-up makes of the passages of a document that have too few signs by themselves. It must apply to most of
        what they cost, and either lower that as much as one passage has to, or lead to contexts that the documents have far more
        often than those of the text."""
        costs = np.array([self.of(part) for part in parts])
        if not parts or not any(self.seen(c) * RARE < self.documents for part in parts for c in contexts(part)):
            return {}
        drops = np.array([self.drops(part) for part in parts])
        taken = drops > 0
        enough = (costs @ taken) >= (1 - KEEP / 2) * costs.sum()
        best: tuple[float, dict[str, str]] = (0.0, {})
        for k in np.flatnonzero(enough):
            table = _table(*SINGLE[k])
            read = {part: part.translate(table) for part, take in zip(parts, taken[:, k], strict=True) if take}
            drop, proof = float(drops[taken[:, k], k].sum()), self.evidence(list(read), table) - _PENALTY[k]
            if (drop >= max(SWAP_DROP, (1 - KEEP) * costs.sum()) or proof >= PROOF) and drop + proof > best[0]:
                best = (drop + proof, read)
        return best[1]

    def repair(self, text: str) -> tuple[str, int, int]:
        """(text as far as it can be restored, repaired passages, passages that stay garbled)."""
        if text.isascii() and "&#" not in text:
            return text, 0, 0
        quoted: list[str] = []

        def hide(match: re.Match) -> str:
            quoted.append(match[0])
            return "`\x00`"

        hidden = _QUOTED.sub(hide, text)
        repaired = left = 0
        if "&#" in hidden:
            plain = _ENTITIES.sub(self._unescaped, hidden)
            repaired += plain != hidden
            hidden = plain
        while not hidden.isascii():
            hidden, layers = self.runs_repaired(hidden)
            if not layers:
                break
            repaired += 1
        if not hidden.isascii() and self.dearest(hidden) >= USUAL:
            lines, open_parts = hidden.split("\n"), []
            for k, line in enumerate(lines):
                if line.isascii() or self.dearest(line) < USUAL:
                    continue
                if fixed := self.letters_repaired(line):
                    lines[k], repaired = fixed, repaired + 1
                    continue
                parts = _SENTENCE.findall(line)
                for n, part in enumerate(parts):
                    if part.isascii():
                        continue
                    if fixed := self.letters_repaired(part):
                        parts[n], repaired = fixed, repaired + 1
                    elif "\ufffd" in part:
                        left += 1
                    elif self.dearest(part) >= USUAL:
                        open_parts.append(part)
                lines[k] = "".join(parts)
            if also := self.together_repaired(open_parts):
                for k, line in enumerate(lines):
                    if not line.isascii():
                        lines[k] = "".join(also.get(part, part) for part in _SENTENCE.findall(line))
                repaired += 1
            hidden = "\n".join(lines)
        if quoted:
            back = iter(quoted)
            hidden = re.sub("`\x00`", lambda _: next(back), hidden)
        return hidden, repaired, left

    def _unescaped(self, match: re.Match) -> str:
        """Numeric references that stand for one garbled sequence become its characters."""
        codes = [int(x) for x in _ENTITY.findall(match[0])]
        if any(not 0x80 <= c < 0x110000 or 0xD800 <= c < 0xE000 for c in codes):
            return match[0]
        text = "".join(map(chr, codes))
        return text if self.run_repaired(" ", text, " ") else match[0]


def _encoded(text: str, legacy: str) -> bytes | None:
    """Bytes of `text` under `legacy`; characters that decoders pass through where a code has no meaning are kept."""
    try:
        return text.encode(legacy)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for c in text:
        try:
            out += c.encode(legacy)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) <= 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


@lru_cache(1000)
def _table(seen: str, was: str) -> dict[int, str]:
    """Characters of the upper half of `seen` to those of the same bytes in `was`."""
    out = {}
    for b in range(0x80, 0x100):
        one = bytes([b])
        try:
            right = one.decode(was)
        except UnicodeDecodeError:
            continue
        try:
            out[ord(one.decode(seen))] = right
        except UnicodeDecodeError:
            out[b] = right
    return out


def contexts(text: str) -> list[str]:
    """Every run of non-ASCII characters with its neighbours; a text's ends count as spaces."""
    text = f" {text} "
    return [text[m.start() - 1 : m.end() + 1] for m in _RUN.finditer(text)]


def signs_of(text: str) -> set[str]:
    """The folded pairs with a non-ASCII character, and the threes with one between two ASCII characters."""
    out = set()
    for c in set(contexts(text)):
        out.update(_key(c[k : k + 2]) for k in range(len(c) - 1))
        if len(c) == 3:
            out.add(_key(c))
    return out


# --- the corpus ---------------------------------------------------------------------------------------------------------
def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (pair, n): in how many texts of the batch each pair (or three) of `signs_of` stands; the texts themselves are
    counted under the empty pair."""
    for batch in batches:
        found: Counter = Counter({"": batch.num_rows})
        for text in batch.column(0).to_pylist():
            found.update(signs_of(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])


def _own(documents: DataFrame) -> DataFrame:
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return docs.where(F.col("text").rlike("[^\\x00-\\x7f]|&#"))


def _judge(state) -> Callable:
    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = Cost(*state.value)
        for batch in batches:
            rows = [(i, *cost.repair(t)) for i, t in enumerate(batch.column(1).to_pylist())]
            rows = [r for r in rows if r[2] or r[3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())],
                ["doc_id", "restored", "repaired_passages", "garbled_passages"],
            )

    return judged


def _state(documents: DataFrame, vocabulary: str | None):
    """What a worker needs to build the cost, broadcast: the pairs that are frequent enough to matter, and the number of documents."""
    docs = spread(_own(documents)).select("text")
    counts = cut(docs.mapInArrow(_counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    total = counts.where("pair = ''").agg(F.sum("n")).first()[0] or 0
    kept = {r["pair"]: r["n"] for r in counts.where("pair <> ''").where(F.col("n") * 2**16 > total + SMOOTH).collect()}
    return documents.sparkSession.sparkContext.broadcast((kept, total, vocabulary))


def repaired_documents(documents: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, restored, repaired_passages, garbled_passages) of every document with a garbled passage."""
    docs = _own(documents)
    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = _judge(_state(documents, vocabulary))
    return spread(docs).mapInArrow(judged, f"doc_id {kind}, restored string, repaired_passages int, garbled_passages int").dropDuplicates(["doc_id"])


def garbled_documents(documents: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id): documents with at least one garbled passage."""
    docs = _own(documents)
    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = _judge(_state(documents, vocabulary))
    return spread(docs).mapInArrow(lambda batches: (b.select([0]) for b in judged(batches)), f"doc_id {kind}").distinct()
