"""Problem 3: records that are the same but for layout, letter case, punctuation or field order.

`layout_copies` groups rows whose text has the same letters and digits in the same order; in blocks of YAML, JSON and
configuration files the heading must agree and the fields under it may stand in any order.

How: the UTF-8 bytes of a whole Arrow batch run through one 256-entry table that skips (0) or folds (weight) each byte,
straight into two rolling polynomial hashes; where other letters than ASCII's stand, bytes become code points and run through a
second table in the same way. No canonical string is built. A block is hashed piece by piece (heading,
keys, values) and its fields are summed, which makes their order irrelevant. Only (id, hash) is shuffled; the rows of
groups of two or more are then compared with their group's first row by a two-pointer comparison that skips and folds
as it goes (fields of blocks in the order of their hashes), and rows that a hash collision had put there are grouped again by an
exact digest of what the comparison sees.

Defined cases: a null text or id is in no group; texts without any letter or digit are equal to each other; repeated
rows of one id count once; ties are decided by the smallest id as text; other columns are ignored, so may bear any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.arrowtext import utf8_buffer, windows
from codequarry.operators.skew import hot_keys, salted_join
from codequarry.session import cut, spread

FIELD_LANGUAGES = ("yaml", "json", "config")
FIELD_EXTENSIONS = (".yaml", ".yml", ".json", ".toml", ".ini", ".env", ".properties", ".cfg", ".conf")

_rng = np.random.default_rng(20260101)
_WEIGHTS = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64)
_BASES = _rng.integers(2**62, 2**63, size=2, dtype=np.uint64) | np.uint64(1)
_KEPT = np.zeros(256, bool)
for _b in range(128):
    _KEPT[_b] = chr(_b).isalnum()
_WEIGHTS[:, 65:91] = _WEIGHTS[:, 97:123]
_WEIGHTS[:, ~_KEPT] = 0

_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_RUN = re.compile(r"[0-9A-Za-z]+|[^\x00-\x7f]+")
_LAST_LETTER = 0x323B0  # above are no letters or digits


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def _fold(sign: str) -> str:
    """A letter or digit in lower case, by itself; nothing for what is skipped."""
    return next((c for c in sign.lower() if c.isalnum()), "")


@lru_cache(1)
def _wide_table() -> np.ndarray:
    """The folded code point of every letter and digit, 0 for what is skipped."""
    return np.array([ord(_fold(chr(code)) or "\0") for code in range(_LAST_LETTER)], np.uint32)


def _code_points(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the place of each one's first byte."""
    at = np.flatnonzero((part & 0xC0) != 0x80)
    size = np.diff(np.append(at, part.size))
    wide = np.concatenate([part, np.zeros(3, np.uint8)]).astype(np.uint32)
    first, out = wide[at], wide[at].copy()
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        own = size == n
        value = first[own] & mask
        for k in range(1, n):
            value = value << 6 | wide[at[own] + k] & 0x3F
        out[own] = value
    return out, at


def _signs(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept?, weights of shape (2, signs), where each text begins) of the signs of some texts' bytes; `at`: where each begins there."""
    if not part.size or part.max() < 128:
        return _KEPT[part], _WEIGHTS[:, part], at
    codes, places = _code_points(part)
    table = _wide_table()
    folded = np.where(codes < _LAST_LETTER, table[np.minimum(codes, _LAST_LETTER - 1)], 0)
    weights = np.stack([_mix(folded.astype(np.uint64) * _BASES[k] + np.uint64(3)) for k in (0, 1)])
    ascii_signs = folded < 128
    weights[:, ascii_signs] = _WEIGHTS[:, folded[ascii_signs]]
    return folded > 0, weights, np.searchsorted(places, at)


def rolling_hashes(texts: pa.Array) -> np.ndarray:
    """Two 64-bit polynomial hashes of the letters and digits of each text, shape (2, rows)."""
    flat, offsets = utf8_buffer(texts)
    out = np.zeros((2, len(offsets) - 1), np.uint64)
    for start, end in windows(offsets, 1 << 18):
        part = flat[offsets[start] : offsets[end]]
        if not part.size:
            continue
        kept, weights, at = _signs(part, offsets[start : end + 1] - offsets[start])
        rank = np.cumsum(kept)
        before = np.concatenate(([0], rank))[at[:-1]]
        sizes = np.diff(at)
        rank -= np.repeat(before, sizes)
        rank[rank < 0] = 0
        full = sizes > 0
        for k in (0, 1):
            step = weights[k] * _powers(_BASES[k], int(rank.max()) + 1)[rank]
            out[k, start:end][full] = np.add.reduceat(step, at[:-1][full])
    return out


_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+|"')


def _json_fields(text: str) -> tuple[str, list[tuple[str, str]]] | None:
    """Heading and (key, value) pairs of an object with one heading, or of a flat object; None if it isn't one."""
    tokens = [(m[0], m.start(), m.end()) for m in _JSON.finditer(text)]
    opens = 0
    while opens + 1 < len(tokens) and tokens[opens][0] == "{" and tokens[opens + 1][0] not in "{}[],:":
        if opens + 3 < len(tokens) and tokens[opens + 2][0] == ":" and tokens[opens + 3][0] == "{":
            heading = tokens[opens + 1][0]
            inner = tokens[opens + 4 :]
            break
        heading, inner = "", tokens[opens + 1 :]
        break
    else:
        return None
    fields, depth, key, start, last = [], 0, None, None, None
    for word, a, b in inner:
        if depth == 0 and word in ("}", ","):
            if key is not None:
                fields.append((key, text[start:last] if start is not None else ""))
            key = start = None
            if word == "}":
                return heading, fields
            continue
        if depth == 0 and word == ":" and start is None:
            continue
        if word in ("{", "["):
            depth += 1
        elif word in ("}", "]"):
            depth -= 1
        if key is None:
            key = word
        else:
            start, last = a if start is None else start, b
    return None


_SPLIT = re.compile(r"\s*[:=]\s*")
_QUOTED_KEY = re.compile(r"""("[^"]*"|'[^']*')\s*[:=]\s*""")


def _key_value(line: str) -> tuple[str, str]:
    stripped = line.strip()
    if m := _QUOTED_KEY.match(stripped):
        return m[1], stripped[m.end() :]
    if stripped[:1] in "#;" or not (m := _SPLIT.search(stripped)):
        return stripped, ""
    return stripped[: m.start()], stripped[m.end() :]


def block_fields(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Heading and fields of a block: JSON objects by their commas, all else by lines (deeper lines belong to the
    field above them)."""
    if text.lstrip()[:1] == "{" and (found := _json_fields(text)):
        return found
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return "", []
    heads: list[str] = []
    while lines and lines[0].lstrip()[:1] in "#;":
        heads.append(lines.pop(0).strip())
    if lines:
        first = lines[0].strip()
        if first.endswith(":") or first[0] == "[" or not _SPLIT.search(first):
            heads.append(first)
            lines = lines[1:]
    heading = "\n".join(heads)
    if not lines:
        return heading, []
    least = min(len(x) - len(x.lstrip()) for x in lines)
    fields: list[tuple[str, str]] = []
    for line in lines:
        if fields and (len(line) - len(line.lstrip()) > least or line.lstrip()[:2] == "- "):
            fields[-1] = (fields[-1][0], fields[-1][1] + "\n" + line)
        else:
            fields.append(_key_value(line))
    return heading, fields


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def layout_hashes(texts: pa.Array, is_block: np.ndarray) -> np.ndarray:
    """Hashes for grouping, shape (2, rows): of the whole text, or for blocks of heading and unordered fields."""
    out = rolling_hashes(texts)
    rows = np.flatnonzero(is_block)
    if not rows.size:
        return out
    pieces, sizes = [], []
    for text in texts.take(pa.array(rows)).to_pylist():
        heading, fields = block_fields(text or "")
        sizes.append(len(fields))
        pieces.append(heading)
        for key, value in fields:
            pieces += (key, value)
    hashed = rolling_hashes(pa.array(pieces, pa.large_string()))
    sizes = np.array(sizes)
    heads = np.concatenate(([0], np.cumsum(1 + 2 * sizes)))[:-1]
    is_head = np.zeros(len(pieces), bool)
    is_head[heads] = True
    for k in (0, 1):
        keys_values = hashed[k][~is_head]
        one = _mix(keys_values[0::2] * np.uint64(3) + _mix(keys_values[1::2]))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(one, dtype=np.uint64)))
        ends = np.cumsum(sizes)
        out[k, rows] = _mix(hashed[k][heads] + np.uint64(7)) + (total[ends] - total[ends - sizes]) * np.uint64(5)
    return out


def _runs(text: str) -> Iterator[str]:
    for m in _RUN.finditer(text):
        run = m[0].lower() if m[0].isascii() else "".join(map(_fold, m[0]))
        if run:
            yield run


def same_but_layout(a: str, b: str) -> bool:
    """Two-pointer comparison that skips and folds while it goes, run by run."""
    if a == b:
        return True
    left, right, x, y = _runs(a), _runs(b), "", ""
    while True:
        x = x or next(left, "")
        y = y or next(right, "")
        if not x or not y:
            return not x and not y
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return False
        x, y = x[n:], y[n:]


def _field_hashes(fields: list[tuple[str, str]]) -> list[tuple[int, int]]:
    hashed = rolling_hashes(pa.array([piece for field in fields for piece in field], pa.large_string()))[0].tolist()
    return list(zip(hashed[0::2], hashed[1::2], strict=True))


def same_block(a: str, b: str) -> bool:
    """Equal headings, and equal fields in any order: fields meet in the order of their hashes and are compared like whole texts."""
    if a == b:
        return True
    (head_a, fields_a), (head_b, fields_b) = block_fields(a), block_fields(b)
    if len(fields_a) != len(fields_b) or not same_but_layout(head_a, head_b):
        return False
    waiting: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for own, field in zip(_field_hashes(fields_b), fields_b, strict=True):
        waiting.setdefault(own, []).append(field)
    for own, (key, value) in zip(_field_hashes(fields_a), fields_a, strict=True):
        others = waiting.get(own, [])
        k = next((k for k, (x, y) in enumerate(others) if same_but_layout(key, x) and same_but_layout(value, y)), None)
        if k is None:
            return False
        others.pop(k)
    return True


def _digest(*pieces: str) -> bytes:
    """Of the runs of some pieces, fed one by one."""
    h = hashlib.blake2b(digest_size=16)
    for piece in pieces:
        for run in _runs(piece):
            h.update(run.encode())
        h.update(b"\0")
    return h.digest()


def exact_digest(text: str, is_block: bool) -> str:
    if not is_block:
        return _digest(text).hex()
    heading, fields = block_fields(text)
    return hashlib.blake2b(_digest(heading) + b"".join(sorted(_digest(k, v) for k, v in fields)), digest_size=16).hexdigest()


def with_block_flag(chunks: DataFrame) -> DataFrame:
    """Adds `_block`: a block of a YAML, JSON or configuration file, by language or, where that is null, extension."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    by_name = F.coalesce(F.lower("language").isin(*FIELD_LANGUAGES), extension.isin(*FIELD_EXTENSIONS), F.lit(False))
    return chunks.withColumn("_block", F.coalesce(F.col("symbol_type") == "block", F.lit(False)) & by_name)


def hashed_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, _block) to (id, h1, h2)."""
    for batch in batches:
        flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        h = layout_hashes(batch.column(1), flags).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[0]), pa.array(h[1])], ["id", "h1", "h2"])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, firsts, flags, texts, models, model_flags = (c.to_pylist() for c in batch.columns)
        same, digests = [], []
        for flag, text, model, model_flag in zip(flags, texts, models, model_flags, strict=True):
            if flag == model_flag:
                ok = same_block(text, model) if flag else same_but_layout(text, model)
            else:
                ok = False
            same.append(ok)
            digests.append(None if ok else exact_digest(text, flag))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(firsts, pa.string()), pa.array(same, pa.bool_()), pa.array(digests, pa.string())],
            ["id", "first_id", "same", "digest"],
        )


def layout_copies(chunks: DataFrame, hot: int = 100_000) -> DataFrame:
    """(first_id, id) for each row of a group of two or more that isn't its smallest id.

    `hot`: groups with more rows than this are spread over several tasks when their rows meet the first row's text.
    """
    rows = with_block_flag(chunks.where("id is not null and text is not null")).select("id", "text", "_block")
    hashed = spread(rows).mapInArrow(hashed_batches, "id string, h1 long, h2 long").distinct()
    groups = hashed.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    hashed = cut(hashed.join(groups.select("h1", "h2"), ["h1", "h2"], "left_semi"))
    groups = cut(hashed.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count("*").alias("n")))
    big = hot_keys(groups, ["h1", "h2"], "n", hot)
    members = salted_join(hashed, groups.drop("n"), big, ["h1", "h2"], F.col("id")).select("id", "first_id")
    texts = rows.join(members.select("id"), "id", "left_semi").dropDuplicates(["id"])
    texts = cut(texts)
    pairs = members.where("id <> first_id").join(texts, "id")
    counts = groups.select("first_id", "n")
    model = texts.join(counts.select(F.col("first_id").alias("id")), "id", "left_semi").select(
        F.col("id").alias("first_id"), F.col("text").alias("model"), F.col("_block").alias("model_block")
    )
    compared = cut(
        salted_join(pairs, model, hot_keys(counts, ["first_id"], "n", hot), ["first_id"], F.col("id"))
        .select("id", "first_id", "_block", "text", "model", "model_block")
        .mapInArrow(_verified, "id string, first_id string, same boolean, digest string")
    )
    sound = compared.where("same").select("first_id", "id")
    # rows that only a collision put into a group: an exact digest groups them anew
    other = compared.where("not same")
    again = other.groupBy("first_id", "digest").agg(F.min("id").alias("least"))
    rest = (
        other.join(again, ["first_id", "digest"])
        .where("id <> least")
        .select(F.col("least").alias("first_id"), "id")
    )
    return sound.unionByName(rest)


def copy_counts(chunks: DataFrame) -> DataFrame:
    """(first_id, copies): one row per group of two or more, with its number of rows, the kept one included."""
    return layout_copies(chunks).groupBy("first_id").agg((F.count("*") + 1).alias("copies"))
