"""Problem 6: credentials embedded in source code.

`found_credentials` gives chunk, line, kind and layers of each; `redacted_chunks` the texts with every credential blanked and
all else, line breaks and lengths included, untouched.

How: rules for what carries a credential (named settings and calls, SQL inserts, authorization values, connection strings and
hook addresses, token formats, private key blocks) run over the text; string literals put together from pieces are judged
joined. Literals and long tokens that are base64, hex, percent or backslash encoded are decoded and scanned again, layer
by layer until nothing decodes any more (each layer is shorter than the one around it, so that ends by itself); what a named value
decodes to is judged in its place. Decoded bytes that are a private key (PKCS#1, DSA, PKCS#8, SEC1, OpenSSH, PKCS#12) are recognised by
parsing their binary grammar to its end; what is found inside redacts the enclosing encoded literal. Chunks are independent: one
scan, without a shuffle but for repeated rows.

Defined cases: null texts or ids give no row; a null path is treated as code; repeated rows of an id count once;
placeholders, masked or empty values, references to variables or vaults, hashes, checksums, ids, public keys, images and
prompts are no credentials.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import spread

SETTINGS = (".yaml", ".yml", ".json", ".toml", ".ini", ".env", ".properties", ".cfg", ".conf", ".npmrc", ".pypirc", ".netrc")

_LITERAL = r""""{3}(?:[^"\\]|\\.|"(?!""))*"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"""
_PIECES = rf"[rbfuRBFU]?(?:{_LITERAL})(?:\s*(?:\+|\.(?=\s*[\"'])|\\\n)?\s*[rbfu]?(?:{_LITERAL}))*"
_FALLBACK = r"(?:(?:[\w.]*\b(?:environ\.get|getenv|getOrDefault|getProperty|get)\(\s*(?:[\"'][\w.-]+[\"'])\s*,\s*)|(?:process\.env(?:\.\w+|\[[\"']\w+[\"']\])\s*(?:\|\||\?\?)\s*)|(?:[\w.]+\s*(?:\|\||\?\?|\bor\b)\s*))"
_TYPE = r"(?:\s*:\s*[A-Za-z_][\w.<>\[\]| ]*?(?=\s*=))?"
_NAMED = re.compile(rf"(?P<key>[A-Za-z_$][\w$.-]*)[\"'`\]]*{_TYPE}[ \t]*(?:(?P<op>:=|=>|=(?!=)|:(?!:|//))|(?P<comma>,))\s*\(?{_FALLBACK}?(?P<value>{_PIECES})")
_BARE = re.compile(
    r"(?P<dash>--)(?P<option>[A-Za-z][\w-]*)(?:=|[ \t]+)(?=(?P<given>[^\s\"'`]+))|(?P<key>[A-Za-z_$][\w$.-]*)[\"']?[ \t]*[=:][ \t]*(?=(?P<value>[^\s\"'`<>\[\]{}(),][^\s\"'`]*))"
)
_CALL = re.compile(rf"(?P<key>[A-Za-z_$][\w$.]*)\(\s*(?P<value>{_PIECES})")
_COMMENT = re.compile(r"\s*(?://|#|\*|--|/\*|;)")

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SECRET_WORDS = frozenset("password passwd pwd pw passphrase secret token jwt apikey credential credentials authtoken accesskey secretkey passwort".split())
_SECRET_ENDS = (("pass",), ("api", "key"), ("access", "key"), ("secret", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("auth", "key"), ("master", "key"), ("service", "key"), ("account", "key"), ("shared", "key"), ("auth", "header"), ("authorization",), ("auth",), ("bearer",), ("dsn",), ("access", "key", "id"), ("payment", "key"))
# what such a name is about when it ends like this is no secret itself
_NO_SECRET = frozenset(
    "policy label hint ref reference name url uri path file field length len size count type prompt hash digest expiry expires ttl min max placeholder title text message id ids rule rules format regex pattern "
    "strength required enabled provider endpoint header headers scheme store manager validator reset page limit budget kind class env var column index usage public location".split()
)
_FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?P<token>(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|gh[oprsu]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{18,}|npm_[A-Za-z0-9]{30,}|xox[a-z]-[A-Za-z0-9-]{12,}|(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|AIza[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{60,}|sk-[A-Za-z0-9_-]{32,})"
)
_BEARER = re.compile(r"\b(?:Bearer|Basic|Token|bearer)[ \t]+(?P<token>[A-Za-z0-9._~+/=-]{16,})")
_CONNECTION = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://(?P<user>[^\s:/@\"'`?#]*):(?P<token>[^\s@\"'`/]{3,})@[\w.\[\]-]+")
_HOOK = re.compile(r"https://hooks?\.[\w.-]+/(?P<token>(?:services|workflows|triggers)/[A-Za-z0-9]+/[A-Za-z0-9/]{8,})|https://[\w.-]*webhook[\w.-]*/(?P<other>[\w/-]*[A-Za-z0-9_-]{20,})|https://(?:discord(?:app)?|canary\.discord)\.com/api/webhooks/(?P<third>\d+/[\w-]{20,})")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>[\s\S]*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)")
_INSERT = re.compile(r"\bINSERT\s+INTO\s+[\w.\"`]+\s*\((?P<columns>[^()]*)\)\s*VALUES\s*", re.I)
_SQL_VALUE = re.compile(r"'(?:[^']|'')*'|[^\s,()]+|[(),;]")
_SQL_PASSWORD = re.compile(r"\b(?:IDENTIFIED\s+BY|(?:WITH|ENCRYPTED|SET)?\s*PASSWORD)\s+'(?P<token>[^']+)'", re.I)
_USER_OPTION = re.compile(r"\bcurl\b[^\n]*?\s(?:-u|--user)[ =]['\"]?[\w.@-]+:(?P<token>[^\s'\"]{6,})")

_REFERENCE = re.compile(
    r"^(?:<[^>]*>|\$\{.*\}|\$[A-Za-z_]\w*|\$\(.*\)|\{\{.*\}\}|\$\{\{.*|%\(?\w+\)?s?|%[A-Z_]+%|#\{.*\}|@\{.*\}|(?:vault|ssm|kms|env|ref|arn|secret|secrets|file|op|sops|awssm|gcp|projects)[:/].*|ENC\[.*|\w+\(.*\)|(?:process\.env|os\.environ|self\.|config\.|settings\.|System\.).*)$"
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:redacted|\[?redacted\]?|change[-_ ]?(?:me|it|this)?|todo|tbd|none|null|nil|true|false|undefined|n/?a|unset|empty|hidden|masked|removed|(?:your|insert|enter|put|add)[-_ ].*|(?:my|the|some|an?)[-_ ](?:own[-_ ]|new[-_ ]|super[-_ ]|very[-_ ])*(?:secrets?|passwords?|passwd|passphrase|tokens?|keys?|api|values?|strings?|credentials?|access|auth|client|placeholder|example)\b.*|(?:example|placeholder|dummy|sample|fake|test|secret|password|passwd|token|key|string|value|pass)(?:[-_ ]?(?:password|token|key|secret|value|only|here|\d{1,3}))?|\.{2,}|-+|_+|\?+)$"
)
_HASHED = re.compile(r"^(?:\$2[aby]\$|\$argon2|\$[156]\$|\{SHA|\{SSHA|pbkdf2|scrypt:|sha(?:1|256|384|512)[-:$]|md5[:$])")


def _masked(value: str) -> bool:
    """Stars, dots or x in place of what was there, or hardly any different characters."""
    core = re.sub(r"[-_.:/ ]", "", value)
    return len(set(core)) < 4 or bool(re.search(r"[*•]{3,}|[xX]{6,}|\.{3,}$", value))


def no_credential(value: str) -> bool:
    return len(value) < 6 or bool(_REFERENCE.match(value) or _PLACEHOLDER.match(value) or _HASHED.match(value)) or _masked(value) or value.startswith("data:")


def key_kind(name: str) -> str | None:
    """What a setting of this name holds: password, secret, or None."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts:
        return None
    for verb in ("with", "set", "get", "add", "use", "has", "is"):
        if len(parts) > 1 and parts[0] == verb:
            parts = parts[1:]
            break
    end = tuple(parts)
    if any(end[-len(e) :] == e for e in _SECRET_ENDS):
        return "password" if end[-1] == "pass" else "secret"
    if parts[-1] in _NO_SECRET:
        return None
    for p in parts:
        if p in _SECRET_WORDS:
            return "password" if p in ("password", "passwd", "pwd", "pw", "passphrase", "passwort") else "secret"
    return None


def _joined(value: str) -> tuple[str, list[tuple[int, int]]]:
    """The content of a literal, or of literals put together, and where its pieces stand in `value`."""
    out, spans = [], []
    for m in re.finditer(_LITERAL, value):
        quote = 3 if m[0][:3] in ('"""', "'''") and len(m[0]) >= 6 else 1
        out.append(m[0][quote:-quote])
        spans.append((m.start() + quote, m.end() - quote))
    return "".join(out), spans


# words of prompts, labels and messages; a passphrase of several words has none of them
_PROSE = frozenset(
    "a an and are as at be but by can cannot change check click confirm contact create current does enter expired failed first for forgot forgotten from get has have hint if in incorrect input invalid is it least link login mail "
    "match matches may minimum missing must need new no not of old on one only optional or our passphrase passwd password passwords please provide repeat required reset same secret send set show should sign strong the their this to "
    "token too try type use user used using valid value was weak we when will with without wrong you your".split()
)


def _passphrase(value: str) -> bool:
    """Whether a quoted value of several words is a passphrase and not something to be read."""
    words = value.split(" ")
    return all(re.fullmatch(r"[\w!@#$%^&*+~-]+", w) for w in words) and not any(w.lower().strip("-") in _PROSE for w in words) and not (value[0].isupper() and value[1:] == value[1:].lower() and not re.search(r"\d", value))


def _plausible(value: str, kind: str) -> bool:
    if no_credential(value):
        return False
    if re.search(r"\s", value):
        return kind == "password" and _passphrase(value)
    if kind == "password":
        return True
    # a secret, token or key is no plain word, path or dotted name
    if re.fullmatch(r"[A-Za-z]+|[\w-]+(?:\.[A-Za-z_]\w*)+|/?(?:[a-z]+/)+[\w.-]*|https?://\S+", value):
        return False
    return len(value) >= 8 and (bool(re.search(r"\d", value)) or len(set(value)) >= 12)


# --- encoded layers ---------------------------------------------------------------------------------------------------
_ENCODED = re.compile(r"(?P<hex>(?<![\w/+])(?:[0-9a-fA-F]{2}){12,}(?![\w/+]))|(?P<base64>(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![\w/+]))")
_ESCAPED = re.compile(r"(?P<escaped>(?:\\x[0-9a-fA-F]{2}|\\u00[0-9a-fA-F]{2}|\\[0-7]{3}){6,})")
_PERCENT = re.compile(r"(?P<percent>[\w.~/+:-]*(?:%[0-9A-Fa-f]{2}[\w.~/+:-]*){4,})")


def encoded_tokens(text: str) -> Iterator[re.Match]:
    """Tokens that may be an encoded layer."""
    yield from _ENCODED.finditer(text)
    if "\\" in text:
        yield from _ESCAPED.finditer(text)
    if "%" in text:
        yield from _PERCENT.finditer(text)


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at `at`; None if it isn't one."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > len(data):
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    return (tag, at, at + n) if at + n <= len(data) else None


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, bytes]] | None:
    """(tag, content) of all DER elements that fill data[start:end] exactly; None if they don't."""
    out, at = [], start
    while at < end:
        inner = _der(data, at)
        if not inner or inner[2] > end:
            return None
        out.append((inner[0], data[inner[1] : inner[2]]))
        at = inner[2]
    return out


def _openssh(data: bytes) -> bool:
    """The OpenSSH grammar: cipher, kdf and its options, the number of keys, each public key, and the private part, all with
    their lengths before them; an unencrypted private part begins with two equal check numbers."""
    at = len(b"openssh-key-v1\0")

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    cipher, kdf, options = field(), field(), field()
    if not cipher or not kdf or options is None or not (cipher + kdf).isascii() or at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(keys):
        if not field():
            return False
    private = field()
    return bool(keys and private) and at == len(data) and (cipher != b"none" or private[:4] == private[4:8])


# fixed values: the first bytes of object identifiers of password-based encryption, and of PKCS#7 contents
_PBE, _PKCS7 = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c"), b"\x2a\x86\x48\x86\xf7\x0d\x01\x07"


def _oid(sequence: bytes) -> bytes:
    """The object identifier that a sequence begins with, or nothing."""
    first = _der(sequence)
    return sequence[first[1] : first[2]] if first and first[0] == 0x06 else b""


def key_container(data: bytes) -> str | None:
    """The kind of private key container that the bytes are, by its grammar."""
    if data.startswith(b"openssh-key-v1\0"):
        return "OpenSSH" if _openssh(data) else None
    outer = _der(data)
    if not outer or outer[0] != 0x30 or outer[2] < len(data.rstrip(b"\r\n")):
        return None
    parts = _elements(data, outer[1], outer[2])
    if not parts:
        return None
    tags = [tag for tag, _ in parts]
    if tags == [0x30, 0x04]:
        return "PKCS#8" if _oid(parts[0][1]).startswith(_PBE) else None
    if tags[0] != 0x02 or len(tags) < 2:
        return None
    version = int.from_bytes(parts[0][1], "big")
    if version in (0, 1) and tags[1:3] == [0x30, 0x04] and _oid(parts[1][1]):
        return "PKCS#8"
    if version == 1 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "SEC1"
    if version in (0, 1) and set(tags) <= {0x02, 0x30} and len(tags) >= 9 and set(tags[:9]) == {0x02} and len(parts[1][1]) >= 32:
        return "PKCS#1"
    if version == 0 and tags == [0x02] * 6 and len(parts[1][1]) >= 32:
        return "DSA"
    return "PKCS#12" if version == 3 and tags[1] == 0x30 and _oid(parts[1][1]).startswith(_PKCS7) else None


def decoded(kind: str, text: str) -> bytes | None:
    try:
        if kind == "base64":
            body = text.rstrip("=").replace("-", "+").replace("_", "/")
            if len(body) % 4 == 1:
                return None
            # most tokens that merely look like base64 decode to noise; a look at the first bytes ends that early
            first = binascii.a2b_base64(body[:12] + "=" * (-len(body[:12]) % 4))
            if not (first[:1] == b"0" or first.startswith(b"openssh-") or all(9 <= c <= 13 or 28 <= c < 127 or c >= 128 for c in first)):
                return None
            return base64.b64decode(body + "=" * (-len(body) % 4))
        if kind == "hex":
            return binascii.unhexlify(text)
        if kind == "percent":
            return unquote_to_bytes(text)
        return re.sub(rb"\\x([0-9a-fA-F]{2})|\\u00([0-9a-fA-F]{2})|\\([0-7]{3})", lambda m: bytes([int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8) & 255]), text.encode("latin-1", "replace"))
    except (ValueError, binascii.Error):
        return None


def _readable(data: bytes) -> str | None:
    """Decoded bytes as text, if they are text."""
    try:
        plain = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return plain if plain.isprintable() or "".join(plain.split()).isprintable() else None


_PADDED = re.compile(r"(?:[A-Za-z0-9+/]{4}){2,}[A-Za-z0-9+/]{2}(?:==|[A-Za-z0-9+/]=)")


def _peeled(value: str) -> tuple[str, int, str | None]:
    """(what a whole value decodes to, the layers taken off, the kind of a key container inside)."""
    layers = 0
    while True:
        token = next((m for m in encoded_tokens(value) if m[0] == value), None)
        data = decoded(token.lastgroup, value) if token else decoded("base64", value) if _PADDED.fullmatch(value) else None
        if not data or len(data) < 6:
            return value, layers, None
        if container := key_container(data):
            return value, layers + 1, container
        plain = _readable(data)
        if plain is None or plain == value:
            return value, layers, None
        value, layers = plain, layers + 1


def _inner(text: str, depth: int) -> tuple[str, int] | None:
    """(kind, layers) of a credential inside an encoded text, if any."""
    for m in encoded_tokens(text):
        data = decoded(m.lastgroup, m[0])
        if not data or len(data) < 6:
            continue
        if kind := key_container(data):
            return f"private key ({kind})", depth + 1
        plain = _readable(data)
        if plain and plain != m[0] and (found := scan(plain, settings=True, depth=depth + 1)):
            return found[0][2], found[0][3]
    return None


# --- the scan -----------------------------------------------------------------------------------------------------------
_TRIGGER = re.compile(
    r"(?i:passw|passphrase|pwd|secret|token|apikey|accesskey|bearer|basic |credential|identified by)|(?:[kK]ey|KEY|[aA]uth|AUTH|[dD]sn|DSN|[jJ]wt|JWT|Pass|(?<![A-Za-z])pass|PASS|[pP]w|PW)(?![a-z])|[aA]uthorization|://|sk_|gh[oprsu]_|xox|AKIA|ASIA|eyJ"
)
# one of these stands, in lower case, in every text with a trigger or a match of the patterns above (tested)
_QUICK = ("pw", "secret", "token", "key", "bearer", "basic", "credential", "identified", "auth", "dsn", "jwt", "pass", "://", "sk_", "pk_", "rk_", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat", "glpat", "npm_", "xox", "akia", "asia", "agpa", "aida", "aroa", "aiza", "sg.", "eyj", "hf_", "dop_v1", "sk-", "curl")

Found = tuple[int, list[tuple[int, int]], str, int]


def scan(text: str, settings: bool = False, depth: int = 0) -> list[Found]:
    """(start, spans to blank, kind, layers) of every credential, in order, without overlaps."""
    found: list[Found] = []

    def add(start: int, spans: list[tuple[int, int]], kind: str, layers: int | None = None) -> None:
        found.append((start, spans, kind, depth if layers is None else layers))

    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\n|[\s\"'+\\]", "", m["body"])
            if len(body) >= 40 and not _masked(body[:60]) and not _REFERENCE.match(m["body"].strip()):
                add(m.start(), [m.span("body")], "private key")
    low = text.lower()
    if any(w in low for w in _QUICK):
        for m in _FORMATS.finditer(text):
            if not _masked(m["token"].split("_")[-1]):
                add(m.start("token"), [m.span("token")], "token")
        for m in _CONNECTION.finditer(text) if "://" in text else ():
            if not no_credential(m["token"] if len(m["token"]) >= 6 else m["token"] + "-" * 6) and not m["token"].startswith(("$", "{", "<", "%")):
                add(m.start(), [m.span("token")], "connection")
        for m in _HOOK.finditer(text) if "https://" in text else ():
            name = "token" if m["token"] else "other" if m["other"] else "third"
            if not _masked(m[name].rsplit("/", 1)[-1]):
                add(m.start(), [m.span(name)], "hook")
        for m in _BEARER.finditer(text) if "earer" in text or "asic" in text or "Token " in text else ():
            if not no_credential(m["token"]) and (re.search(r"\d", m["token"]) or len(set(m["token"])) > 12):
                add(m.start(), [m.span("token")], "authorization")
        for m in _SQL_PASSWORD.finditer(text) if "passw" in low or "identified" in low else ():
            if _plausible(m["token"], "password"):
                add(m.start("token"), [m.span("token")], "password")
        for m in _USER_OPTION.finditer(text) if "curl" in text else ():
            if _plausible(m["token"], "password"):
                add(m.start("token"), [m.span("token")], "password")
        for m in _INSERT.finditer(text) if "insert" in low else ():
            _inserted(text, m, add)
        _named(text, settings, add, depth)
    # encoded layers that no setting's name gives away
    for m in encoded_tokens(text):
        if text[max(0, m.start() - 8) : m.start()].endswith("base64,") or any(s <= m.start() < e for f in found for s, e in f[1]):
            continue
        if inner := _inner(m[0], depth):
            add(m.start(), [m.span()], *inner)
    return _disjoint(found)


def _disjoint(found: list[Found]) -> list[Found]:
    out: list[Found] = []
    for f in sorted(found, key=lambda f: (f[0], -f[1][-1][1])):
        if not any(s < f[1][-1][1] and f[1][0][0] < e for g in out for s, e in g[1]):
            out.append(f)
    return out


def _inserted(text: str, m: re.Match, add) -> None:
    """Values of password columns of an INSERT, row by row."""
    kinds = [key_kind(c.strip(" \n\t\"`[]")) for c in m["columns"].split(",")]
    if not any(kinds):
        return
    place, depth = 0, 0
    for v in _SQL_VALUE.finditer(text, m.end()):
        word = v[0]
        if word == "(":
            depth += 1
            place = 0 if depth == 1 else place
        elif word == ")":
            depth -= 1
        elif word == ";":
            return
        elif word == ",":
            place += depth == 1
        elif depth == 0:
            return
        elif depth == 1 and word[0] == "'" and place < len(kinds) and kinds[place] and _plausible(word[1:-1], kinds[place]):
            add(v.start(), [(v.start() + 1, v.end() - 1)], kinds[place])


_NAME_START = re.compile(r"[A-Za-z_$]")
_NAME_SIGNS = frozenset("_$.-")
_NAME_END = re.compile(r"[\w$.-]*")
_OPTION = re.compile(r"--(?=[A-Za-z])")
_key_kind = lru_cache(200_000)(key_kind)


def _names(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every word with a trigger, whole, each once: a name like a credential's always has one."""
    end = 0
    for t in _TRIGGER.finditer(text):
        at = t.start()
        if at < end:
            continue
        start = at
        while start > end and ((c := text[start - 1]).isalnum() or c in _NAME_SIGNS):
            start -= 1
        end = _NAME_END.match(text, at).end()
        if end > start:
            yield start, end


def _named(text: str, settings: bool, add, depth: int) -> None:
    """Values given to settings, variables, fields and calls that are named like credentials."""
    line, seen, comment = -1, 0, False
    for start, end in _names(text):
        first = _NAME_START.search(text, start, end)
        if not first:
            continue
        at = text.rfind("\n", seen, start) + 1
        seen = start
        if line < 0 or at:
            line = at
            comment = bool(_COMMENT.match(text, line))
        _given(text, first.start(), end, add, depth)
        if settings or comment or "--" in text[start:end]:
            _bare(text, start, first.start(), end, settings, comment, add, depth)


def _given(text: str, start: int, end: int, add, depth: int) -> None:
    """The quoted value that the name at `start` is given."""
    name = text[start:end]
    kind = _key_kind(name)
    if not kind:
        return
    m = _NAMED.match(text, start) or _CALL.match(text, start)
    if not m or (m.re is _NAMED and m["comma"] and not (start and text[start - 1] == text[end] and text[end] in "\"'`")):
        return
    if m.re is _CALL and not (kind := _key_kind(name.rsplit(".", 1)[-1])):
        return
    value, spans = _joined(m["value"])
    at = m.start("value")
    spans = [(at + s, at + e) for s, e in spans]
    if not spans:
        return
    plain, layers, container = _peeled(value)
    if container:
        add(at, spans, f"private key ({container})", depth + layers)
    elif _plausible(plain, kind):
        add(at, spans, kind, depth + layers)
    elif not no_credential(value) and (inner := _inner(value, depth)):
        add(at, spans, *inner)


def _bare(text: str, start: int, first: int, end: int, settings: bool, comment: bool, add, depth: int) -> None:
    """The unquoted values of the name or options in a word; the word bounds where a match starts, not its value."""
    upto = start
    for at in sorted({first, *(o.start() for o in _OPTION.finditer(text, start, end))}):
        m = _BARE.match(text, at) if at >= upto else None
        if not m:
            continue
        upto = m.end()
        kind = _key_kind(m["option"] or m["key"])
        if not kind or not (settings or m["dash"] or comment):
            continue
        which = "given" if m["dash"] else "value"
        value = re.sub(r"(?:\*/|[,;)}\]]+)$", "", m[which])
        plain, layers, container = _peeled(value)
        if container or (_plausible(plain, kind) and not re.search(r"\s", value) and (layers or m["dash"] or "(" not in value)):
            add(m.start(which), [(m.start(which), m.start(which) + len(value))], f"private key ({container})" if container else kind, depth + layers)


def redact(text: str, found: list[Found]) -> str:
    """The text with every credential's characters blanked; line breaks, quotes and all around them stay."""
    out = list(text)
    for _, spans, _, _ in found:
        for s, e in spans:
            piece = text[s:e]
            keep = re.compile(r"\\n|\\\n|[\s\"'`+]") if "\n" in piece else None
            k = s
            while k < e:
                if keep and (m := keep.match(text, k)):
                    k = m.end()
                    continue
                out[k] = "*"
                k += 1
    return "".join(out)


def _is_settings(path: str | None) -> bool:
    return bool(path) and path.lower().endswith(SETTINGS)


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, path, text) to (id, line_no, kind, layers)."""
    for batch in batches:
        rows = []
        for k, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for start, _, kind, layers in scan(text, _is_settings(path)):
                rows.append((k, text.count("\n", 0, start) + 1, kind, layers))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())],
            ["id", "line_no", "kind", "layers"],
        )


def _redacted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if found := scan(text, _is_settings(path)):
                rows.append((k, len(found), redact(text, found)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["id", "credentials", "redacted"]
        )


def _own(chunks: DataFrame) -> DataFrame:
    return chunks.where("id is not null and text is not null").select("id", "path", "text")


def found_credentials(chunks: DataFrame) -> DataFrame:
    """(id, line_no, kind, layers): each credential once; `layers` counts the encodings around it."""
    return spread(_own(chunks)).mapInArrow(_scanned, "id string, line_no int, kind string, layers int").distinct()


def credential_lines(chunks: DataFrame) -> DataFrame:
    """(id, line_no) of every credential."""
    return found_credentials(chunks).select("id", "line_no").distinct()


def redacted_chunks(chunks: DataFrame) -> DataFrame:
    """(id, credentials, redacted): the blanked text of every chunk that holds a credential."""
    return spread(_own(chunks)).mapInArrow(_redacted, "id string, credentials int, redacted string").dropDuplicates(["id"])
