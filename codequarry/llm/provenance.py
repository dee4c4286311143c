"""Problem 2: generated, minified and vendored source files, and data saved as code.

`foreign_files` gives the files that were not written by hand in their repository, with the reason; `handwritten_files` the
rest.

How: identifiers are read from every file without its strings and comments. Character trigram counts of the identifiers of all
files, one model per language, are aggregated by Spark; a model has at most 31^3 trigrams, so all of them together stay
under a documented bound and are broadcast. A second pass scores each file: the cross-entropy of its identifiers decides about
mangled names of minified code and bundles, at any length of lines; the diversity of its line shapes and of its names' affixes
shows templates of generators and compilers; the share of literal data shows data. Naming styles (of the file's name and of its
identifiers) are counted over all files that nothing else flags, by repository and by language: a file whose name bears a style that
hardly any other file of its repository and hardly any of its language bears is a copy from elsewhere, and so is one of a rare style
whose identifiers are of a foreign style too. A file's own words (a generator's note, an origin with version or revision)
and its place in a directory for foreign or generated code add what the statement of the problem names expressly.

Defined cases: null contents count as empty; empty files are hand-written unless they lie in a directory for foreign
code; null paths are judged by content only; repeated rows of a file count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut, spread

# fixed values: extension to language of the identifier models
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".pyw": "python", ".ts": "script", ".mts": "script", ".cts": "script", ".tsx": "script", ".js": "script", ".mjs": "script",
    ".cjs": "script", ".jsx": "script", ".java": "java", ".sql": "sql", ".psql": "sql", ".pgsql": "sql", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
}
OTHER = "settings"

_STRINGS = r""""{3}[\s\S]*?"{3}|'{3}[\s\S]*?'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"""
_SLASHED = re.compile(rf"/\*[\s\S]*?\*/|//[^\n]*|{_STRINGS}")
_HASHED = re.compile(rf"\#[^\n]*|{_STRINGS}")
_DASHED = re.compile(rf"/\*[\s\S]*?\*/|--[^\n]*|{_STRINGS}")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
# words of the languages themselves say nothing about who named things
_KEYWORDS = frozenset(
    "abstract and any as assert async await boolean break case catch char class const continue debugger declare def default del delete do double elif else enum except export exports extends "
    "false final finally float for from function get global if implements import in instanceof int interface is keyof lambda let long module namespace new nonlocal none not null number object of or package "
    "pass private protected public raise readonly record return self set short static str string super switch symbol synchronized this throw throws transient true try type typeof undefined unknown use var void volatile while with yield".split()
)


def _literals(language: str) -> re.Pattern:
    return _HASHED if language in ("python", "yaml", OTHER) else _DASHED if language == "sql" else _SLASHED


def without_literals(text: str, language: str) -> str:
    return _literals(language).sub(lambda m: '""' if m[0][0] in "\"'`" else " ", text)


def identifiers(code: str) -> Counter:
    found = Counter(_IDENTIFIER.findall(code))
    for word in [w for w in found if w.lower() in _KEYWORDS]:
        del found[word]
    return found


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
# 31 signs: a boundary (0), 26 letters, underscore, dollar, digit, anything else
_SIGNS = np.full(256, 30, np.int64)
_SIGNS[97:123] = np.arange(1, 27)
_SIGNS[[95, 36, 10]] = 27, 28, 0
_SIGNS[48:58] = 29


def gram_codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character trigrams of all names end to end, as numbers below 32^3, and the name of each."""
    joined = "\n" + _CAMEL.sub("_", "\n".join(names)).lower() + "\n"
    signs = _SIGNS[np.frombuffer(joined.encode("latin-1", "replace"), np.uint8)]
    inside = signs[1:-1] != 0
    codes = (signs[:-2] * 32 + signs[1:-1]) * 32 + signs[2:]
    return codes[inside], np.cumsum(~inside)[inside]


def _language(extension: str | None) -> str:
    return LANGUAGES.get((extension or "").lower(), OTHER)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(extension, content) to (language, gram, n): the batch's identifier trigrams, every name once a file."""
    for batch in batches:
        names: dict[str, Counter] = {}
        for extension, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            language = _language(extension)
            names.setdefault(language, Counter()).update(identifiers(without_literals(text, language)).keys())
        for language, own in names.items():
            if not own:
                continue
            codes, name = gram_codes(list(own))
            counts = np.bincount(codes, np.fromiter(own.values(), np.float64)[name], minlength=32**3)
            grams = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(grams), pa.string()), pa.array(grams, pa.int32()), pa.array(counts[grams].astype(np.int64))], ["language", "gram", "n"]
            )


class NameModel:
    """Character trigram model with add-one smoothing; entropy in bits a character."""

    def __init__(self, grams: dict[int, int]):
        counts = np.zeros((32 * 32, 32))
        counts.ravel()[list(grams)] = list(grams.values())
        self.bits = -np.log2((counts + 1) / (counts.sum(axis=1, keepdims=True) + 31)).astype(np.float32).ravel()
        # what a character costs on average over the language's own names
        self.usual = float((counts.ravel() * self.bits).sum() / max(1.0, counts.sum()))

    def entropy(self, names: list[str]) -> float:
        """The mean over the names of their bits a character."""
        codes, name = gram_codes(names)
        totals = np.bincount(name, self.bits[codes], minlength=len(names))
        return float(np.mean(totals / np.maximum(1, np.bincount(name, minlength=len(names)))))


def name_models(files: DataFrame) -> dict[str, NameModel]:
    """One model per language, from every file. At most 10 languages times 31^3 trigrams reach the driver (5 MB)."""
    counted = spread(files.where("content is not null").select("extension", "content")).mapInArrow(_counted, "language string, gram int, n long")
    grams: dict[str, dict[int, int]] = {}
    for language, gram, n in counted.groupBy("language", "gram").agg(F.sum("n")).collect():
        grams.setdefault(language, {})[gram] = n
    return {language: NameModel(g) for language, g in grams.items()}


# --- signs in a file's own words and place ------------------------------------------------------------------------------
_GENERATED = re.compile(
    r"(?i)@generated\b|<auto-?generated|\bauto-?generated (?:on|by|from|file)|\b(?:code|file|class|module|sources?) (?:is |was |has been )?(?:auto(?:matically)?[- ])?generated (?:by|from|with)\b"
    r"|\bautomatically generated\b|^\W*generated (?:by|from|with|on)\b|\bdo not (?:edit|modify|change)(?: (?:by hand|manually|directly|this file))?\s*(?:[.!;*\n]|$)|\bdo not change by hand|\bplease do not (?:edit|modify)",
    re.M,
)
_TOOL_OUTPUT = re.compile(r"Object\.defineProperty\(exports, ?[\"']__esModule[\"']|^//[#@] sourceMappingURL=|__webpack_require__|webpackBootstrap|\"lockfileVersion\"\s*:", re.M)
_ORIGIN = re.compile(
    r"(?i)\b(?:vendored|copied|taken|imported|adapted|forked|bundled|mirrored) from\s+[\w./-]+\s*(?:at|@|,|\(|version|v|rev(?:ision)?)?\s*(?:v?\d+\.\d+|[0-9a-f]{7,40}\b)"
    r"|\bthis file is (?:part|a copy) of\s+[\w.-]+,?\s+(?:version\s+)?v?\d+\.\d+|\b[\w.-]+\s+v\d+\.\d+\.\d+\b[^\n]*\n\W*\(c\)|/\*!\s*[\w.@/-]+\s+v?\d+\.\d+"
)
_FOREIGN_PLACE = re.compile(r"(?:^|/)(?:vendor|vendored|third[_-]?party|node_modules|bower_components|site-packages|external|externals|extern|deps|Pods|jspm_packages)/(?=[^/]+/)")
# under a source root such a name is more often a package of one's own ("vendor" as a trade word)
_SOURCE_ROOT = re.compile(r"(?:^|/)(?:src|lib|app|main|source|sources)/")
_TOOL_PLACE = re.compile(r"(?:^|/)(?:generated|__generated__|auto[_-]?generated|autogen|generated-sources|generated-src|gen)/|_pb2(?:_grpc)?\.pyi?$|\.pb\.[a-z]+$|\.g\.[a-z]+$|\.generated\.[a-z]+$|[.-]min\.[a-z]+$|/(?:package-lock|npm-shrinkwrap)\.json$", re.I)
_BUILD_PLACE = re.compile(r"(?:^|/)(?:dist|build|out|target|esm|cjs|public|static|assets|bundle|lib)/", re.I)


# comments of settings and of languages without a model of their own
_NOTES = re.compile(rf"/\*[\s\S]*?\*/|<!--[\s\S]*?-->|^[ \t]*(?:\#|//|--|;|%)[^\n]*|\#[^\n]*|{_STRINGS}", re.M)
_ANNOTATION = re.compile(r"^@(?:[\w.]+\.)?Generated\b", re.M)
_SENTENCE = re.compile(r"(?i)(?:^|[.!:_])\W*(?:(?:note|notice|warning|attention|nb)\W+)?(?:this(?: \w+){0,2}|the following)?\W*$")


def own_words(text: str, language: str) -> str:
    """A file's comments at top level, wherever they stand: at the start of a line, outside brackets or before all code. Python's
    text statements count too, and, as JSON has no comments, the strings of its outer object. Code between them becomes `_`."""
    out, last, depth, bare = [], 0, 0, True
    for m in (_NOTES if language == OTHER else _literals(language)).finditer(text):
        code = text[last : m.start()]
        last = m.end()
        depth += sum(map(code.count, "([{")) - sum(map(code.count, ")]}"))
        bare = bare and not code.strip()
        first = text[text.rfind("\n", 0, m.start()) + 1 : m.start()] in ("", "r", "R", "u", "U", "\ufeff")
        if m[0].lstrip()[0] in "\"'`":
            take = depth <= 1 if language == "json" else first and language == "python"
            bare = bare and take
        else:
            take = bare or first or (depth <= 0 and language not in ("python", "yaml", OTHER))
        if code.strip():
            out.append("_")
        if take:
            out.append(m[0])
    return "\n".join(out)


def generators_note(words: str) -> str:
    """clear: a comment says that the file is generated; weak: it asks not to edit, or speaks of generated things; else nothing."""
    found = ""
    for m in _GENERATED.finditer(words):
        note = m[0].lower()
        if "@generated" in note or note.startswith("<auto"):
            return "clear"
        if "generated" in note and _SENTENCE.search(words[max(0, m.start() - 200) : m.start()]):
            return "clear"
        found = "weak"
    return found


def longest_run(text: str, language: str) -> str:
    """The longest stretch of code without comments."""
    best, last = "", 0
    for m in _literals(language).finditer(text):
        if m[0][0] not in "\"'`":
            best = max(best, text[last : m.start()].strip(), key=len)
            last = m.end()
    return max(best, text[last:].strip(), key=len)


def name_style(path: str | None) -> str:
    """The naming style of a file's name."""
    stem = (path or "").rsplit("/", 1)[-1].split(".")[0].strip("_")
    if "-" in stem:
        return "kebab"
    if "_" in stem:
        return "snake"
    if stem[:1].isupper():
        return "pascal"
    return "camel" if stem != stem.lower() else "plain"


def identifier_style(names: list[str]) -> str:
    """The style that most of a file's names of several words have: snake, camel or nothing."""
    snake = sum("_" in x.strip("_") and not x.isupper() for x in names)
    camel = sum(bool(_HUMP.search(x)) and not x[0].isupper() for x in names)
    if snake + camel < STYLED_NAMES:
        return ""
    return "snake" if snake >= 0.6 * (snake + camel) else "camel" if camel >= 0.6 * (snake + camel) else ""


_HUMP = re.compile(r"[a-z][A-Z]")
_SHAPE_NAMES = re.compile(r"[A-Za-z_$][\w$]*")
_SHAPE_NUMBERS = re.compile(r"\d[\w.]*")
_KEPT_WORDS = {w: w for w in _KEYWORDS}


def line_shapes(code: str, language: str) -> tuple[int, float]:
    """(lines, distinct shapes a line): shapes keep the language's words and marks, names and numbers become one sign."""
    kept = _KEPT_WORDS.get
    code = _SHAPE_NUMBERS.sub("0", _SHAPE_NAMES.sub(lambda m: kept(m[0], "w"), code))
    shapes = Counter(map(str.strip, code.split("\n")))
    for blank in [x for x in shapes if len(x) < 2]:
        del shapes[blank]
    n = sum(shapes.values())
    return n, len(shapes) / n if n else 1.0


_AFFIX_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|^_+|_+$")
_affix_parts = lru_cache(300_000)(_AFFIX_PARTS.findall)


def affix_share(names: Counter) -> float:
    """The share of names that carry the commonest long affix or a mark of generated names: how template-like they are."""
    if len(names) < 6:
        return 0.0
    affixes: Counter = Counter()
    for name in names:
        parts = _affix_parts(name)
        if len(parts) > 1:
            affixes["<" + parts[0]] += 1
            affixes[">" + parts[-1]] += 1
        if len(parts) > 2:
            affixes[">" + "".join(parts[-2:])] += 1
    return affixes.most_common(1)[0][1] / len(names) if affixes else 0.0


_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{120,}")
_NUMBERS = re.compile(r"(?<![\w.])(?:(?:0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?)\s*,\s*){12,}")


def literal_share(text: str, language: str) -> float:
    """The share of the text that is encoded data: long base64 or hex strings, runs of numbers, records of one shape."""
    n = len(text)
    if n < 200:
        return 0.0
    blob = sum(len(m) for m in _BLOB.findall(text))
    numbers = sum(len(m) for m in _NUMBERS.findall(text)) if text.count(",") * 30 > n else 0
    records = 0
    if language == "json" and text.lstrip()[:1] == "[":
        one = lambda m: m[0] if m[1] else "0"
        shapes = Counter(re.sub(r'"(?:[^"\\]|\\.)*"(\s*:)?|-?\d[\d.eE+-]*|true|false|null', one, m) for m in re.findall(r"\{[^{}]*\}", text))
        if shapes and shapes.most_common(1)[0][1] >= 8:
            records = n
    return min(1.0, (blob + numbers + records) / n)


def place_of(path: str | None) -> str:
    """foreign, perhaps (such a directory under a source root), tool or nothing."""
    if path and (m := _FOREIGN_PLACE.search(path)):
        return "perhaps" if _SOURCE_ROOT.search(path[: m.start() + 1]) else "foreign"
    return "tool" if path and _TOOL_PLACE.search(path) else ""


def features(text: str, path: str | None, extension: str | None, models: dict[str, NameModel]) -> dict:
    """The scores of one file."""
    language = _language(extension)
    code = without_literals(text, language)
    names = identifiers(code)
    model = models.get(language)
    lines, diversity = line_shapes(code, language)
    low = text.lower()
    generated = "generated" in low or "do not " in low
    origin = "ed from" in low or "taken from" in low or "this file is" in low or "(c)" in low or "/*!" in low
    words = own_words(text, language) if generated or origin else ""
    note = generators_note(words) if generated else ""
    if language == "java" and note != "clear" and "generated" in low and _ANNOTATION.search(code):
        note = "clear"
    per_line = len(text) / (text.count("\n") + 1)
    # a long line among many short ones of comments: the longest run of code is judged by itself
    if per_line < MANGLED_LINE and max(map(len, text.split("\n"))) >= MANGLED_LINE:
        run = longest_run(text, language)
        per_line = max(per_line, len(run) / (run.count("\n") + 1))
    listed = list(names)
    short = sum(len(x) <= 3 for x in listed) / len(listed) if listed else 0.0
    tool = any(w in text for w in ("__esModule", "sourceMappingURL", "webpack", "lockfileVersion"))
    return {
        "language": language,
        # cross-entropy against what is usual in the language: 1 is a usual name
        "entropy": model.entropy(listed) / max(model.usual, 0.1) if model and listed else 0.0,
        "names_style": identifier_style(listed),
        "short": short,
        "names": len(listed),
        "per_line": per_line,
        "lines": lines,
        "diversity": diversity,
        "affixes": affix_share(names) if diversity * lines <= LIKELY_SHAPES + 0.5 or diversity <= LIKELY_DIVERSITY else 0.0,
        "literals": literal_share(text, language),
        "says_generated": bool(note),
        # JSON has strings for comments, which are about data as well
        "clearly_generated": note == "clear" and language != "json",
        "tool_output": tool and bool(_TOOL_OUTPUT.search(text)),
        "origin": origin and bool(_ORIGIN.search(words)),
        "place": place_of(path),
    }


# Thresholds, set on hand-written files: their names cost under 1.2 times what is usual except in tiny or broken files, their
# lines under 150 characters on average, and from ten lines on they have six line shapes or more. Of 30 names or more (sf0.1) at
# most 0.15 are short, in minified files 0.27 or more; a broken file of 31 names had 0.23. Up to 222 lines they have 0.16 shapes a
# line or more, generated files of over 80 lines at most 0.02.
MANGLED_COST, MANGLED_SHORT, MOSTLY_SHORT, MANGLED_LINE, MANGLED_NAMES = 1.27, 0.2, 0.6, 200, 20
STYLED_NAMES = 15
TEMPLATE_LINES, TEMPLATE_SHAPES, LIKELY_SHAPES, LIKELY_AFFIXES = 10, 3, 6, 0.2
TEMPLATE_DIVERSITY, LIKELY_DIVERSITY = 0.02, 0.06
DATA_SHARE = 0.5


def verdict(f: dict) -> str | None:
    """Why a file isn't hand-written; `style?` if the repository's naming style alone has to decide; None if nothing but a style
    can show it."""
    shapes = f["diversity"] * f["lines"]
    code = f["language"] in ("python", "script", "java")
    if f["literals"] >= DATA_SHARE:
        return "data"
    if f["per_line"] >= MANGLED_LINE and (f["entropy"] >= MANGLED_COST or (f["entropy"] >= 1 and f["short"] >= MANGLED_SHORT)) and f["language"] not in ("json", "yaml"):
        return "minified"
    # lines of usual length: many short names as well
    if f["names"] >= MANGLED_NAMES and f["entropy"] >= MANGLED_COST and f["short"] >= (MANGLED_SHORT if f["names"] >= 3 * MANGLED_NAMES else MOSTLY_SHORT) and (code or f["language"] == "sql"):
        return "minified"
    if code and f["lines"] >= TEMPLATE_LINES and (shapes <= TEMPLATE_SHAPES + 0.5 or f["diversity"] <= TEMPLATE_DIVERSITY):
        return "generated"
    if code and f["lines"] >= TEMPLATE_LINES and (shapes <= LIKELY_SHAPES + 0.5 or f["diversity"] <= LIKELY_DIVERSITY) and (f["affixes"] >= LIKELY_AFFIXES or f["says_generated"] or f["tool_output"] or f["place"] == "tool"):
        return "generated"
    if f["place"] == "foreign" or f["origin"]:
        return "vendored"
    if f["clearly_generated"] or f["tool_output"] or (f["place"] == "tool" and f["diversity"] <= 0.5) or (f["says_generated"] and (f["diversity"] <= 0.5 or f["lines"] < TEMPLATE_LINES)):
        return "generated"
    return "style?" if f["place"] == "perhaps" else None


_SCORED = ["file_id", "repo", "language", "style", "names_style", "reason"]


def _scored(models):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file_id, repo, relative_path, extension, content) to (file_id, repo, language, style, names_style, reason)."""
        for batch in batches:
            rows = []
            for repo, path, extension, text in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                f = features(text or "", path, extension, models.value)
                rows.append((repo, f["language"], name_style(path), f["names_style"], verdict(f)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], _SCORED)

    return score


CODE = ("python", "script", "java")


def _foreign_styles(scored: DataFrame, foreign: float, rare: float, least_files: int) -> DataFrame:
    """(file_id): files that a naming style alone shows to be copies from elsewhere. Shares leave the file itself out and are taken
    of the files that nothing else flags. Only files whose style is rare in their whole language, a small part of all by
    definition, are joined with the shares of their repository."""
    home = scored.where("reason is null").where(F.col("language").isin(*CODE))
    counted = lambda *by: home.groupBy(*by).agg(F.count("*").alias("n"))

    def share(column: str, by: list[str], name: str) -> DataFrame:
        each = counted(*by, column)
        total = each.groupBy(*by).agg(F.sum("n").alias(f"{name}_total"))
        return each.withColumnRenamed("n", name).join(total, by)

    # languages times styles: at most 15 rows
    files, names = share("style", ["language"], "files"), share("names_style", ["language"], "names")
    unsure = scored.where("reason is null or reason = 'style?'").where(F.col("language").isin(*CODE)).withColumn("own", F.when(F.col("reason").isNull(), 1).otherwise(0))
    known = unsure.join(F.broadcast(files), ["language", "style"], "left").join(F.broadcast(names), ["language", "names_style"], "left").fillna(0)
    part = lambda n, total: F.greatest(F.col(n) - F.col("own"), F.lit(0)) / F.greatest(F.col(total) - F.col("own"), F.lit(1))
    odd_file = (F.col("style") != "plain") & (part("files", "files_total") < rare)
    odd_names = (F.col("names_style") != "") & (part("names", "names_total") < rare)
    candidates = known.withColumn("odd_file", odd_file).withColumn("odd_names", odd_names).where("odd_file or odd_names or reason = 'style?'")
    candidates = candidates.select("file_id", "repo", "language", "style", "own", "odd_file", "odd_names", "reason")
    local = candidates.join(share("style", ["repo", "language"], "here").drop("here_total"), ["repo", "language", "style"], "left")
    local = local.join(counted("repo", "language").withColumnRenamed("n", "here_total"), ["repo", "language"], "left").fillna(0, ["here", "here_total"])
    strange = part("here", "here_total") < foreign
    enough = F.col("here_total") - F.col("own") >= least_files
    return local.where(strange & (F.col("reason").isNotNull() | (enough & (F.col("odd_file") | (F.col("odd_names") & (F.col("style") != "plain")))))).select("file_id")


def flagged_files(files: DataFrame, foreign_style: float = 0.02, rare_style: float = 0.005, least_files: int = 5) -> DataFrame:
    """(file_id, reason): generated, minified, vendored or data; one row per file that isn't hand-written.

    `foreign_style`: a naming style that fewer of the repository's own files of the language bear is foreign to it; `rare_style`: the
    same of all files of the language; `least_files`: of how many other files a repository's style can be judged.
    """
    own = files.where("file_id is not null").select("file_id", "repo", "relative_path", "extension", "content")
    models = files.sparkSession.sparkContext.broadcast(name_models(own))
    kind = own.schema["file_id"].dataType.simpleString()
    schema = f"file_id {kind}, repo string, language string, style string, names_style string, reason string"
    scored = cut(spread(own).mapInArrow(_scored(models), schema).distinct())
    foreign = _foreign_styles(scored, foreign_style, rare_style, least_files).select("file_id", F.lit("vendored").alias("reason"))
    return scored.where("reason <> 'style?'").select("file_id", "reason").unionByName(foreign).groupBy("file_id").agg(F.min("reason").alias("reason"))


def foreign_files(files: DataFrame) -> DataFrame:
    """(file_id): files that were not written by hand in their repository."""
    return flagged_files(files).select("file_id")


def handwritten_files(files: DataFrame) -> DataFrame:
    """The rows of hand-written files."""
    return files.join(foreign_files(files), "file_id", "left_anti")


def reasons_by_repo(files: DataFrame) -> DataFrame:
    """(repo, reason, files): how many files of each repository were flagged, by reason."""
    named = files.where("file_id is not null").select("file_id", "repo").dropDuplicates(["file_id"])
    return flagged_files(files).join(named, "file_id").groupBy("repo", "reason").agg(F.count("*").alias("files"))
