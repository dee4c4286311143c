"""Problem 1: source files that do not parse.

`invalid_files` gives the files whose content every supported dialect of the language of their extension rejects;
`invalid_rates` the shares per repository and language.

How: a lexer turns the text into token masks, bracket groups (in Python also indented suites, in YAML deeper lines) are
folded innermost first to one token that stands for every construct the group may derive, and each remaining piece (a
statement, a member, a group's content) is recognised by generalised LL with a graph-structured stack
(`gll.Grammar.accepted`), all dialects' and constructs' start symbols on one stack. Code repeats its shapes, so pieces
are recognised once per worker and looked up by their token sequence from then on; every file is still lexed, folded and
judged whole. Files are independent, so the job is one scan without a shuffle but for repeated rows.

Dialects: Python 3; JavaScript as script and as module; TypeScript; Java; common SQL (with the usual additions of PostgreSQL, MySQL
and SQLite); YAML; strict JSON; TOML for .toml and sections with `key = value` for .ini.

Defined cases: null contents and files that are empty or only white space are valid, as are extensions without grammar
(.env, .properties); repeated rows of a file count once; names, types and imports need not resolve.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import grammars as G
from codequarry.llm.gll import NL, Grammar
from codequarry.session import spread

MEMO = 400_000  # remembered pieces per language and worker; the memory is cleared when it is full


class Rejected(Exception):
    """The text is in no supported dialect."""


def _alternation(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def collapsed(tokens: tuple, comma: int) -> tuple:
    """Long lists with equal neighbouring elements keep three of each: lists accept one more element of a kind if they
    accept three."""
    if len(tokens) < 24 or comma not in tokens:
        return tokens
    out, element, last, same = [], [], None, 0
    for t in (*tokens, comma):
        element.append(t)
        if t == comma:
            same = same + 1 if element == last else 0
            if same < 3:
                out += element
            last, element = element, []
    return tuple(out[:-1])


class Language:
    """Tokens, groups and remembered pieces of one grammar. A token id is an index into `masks`."""

    comma_only = True

    def __init__(self, text: str, groups: dict, pieces: tuple = (), reserved: str = "", contextual: str = "", words: dict | None = None, punctuation: dict | None = None, nl: bool = False, fold_case: bool = False):
        self.grammar = g = Grammar(text)
        self.masks: list[int] = []
        self.ids: dict[int, int] = {}
        self.groups, self.pieces, self.nl = groups, pieces, nl
        self.piece_memo: dict[tuple, int] = {}
        self.group_memo: dict[tuple, int] = {}
        name = g.mask("NAME", "IDENT", "WILD", "NAMEISH")
        self.words: dict[str, int] = {}
        for w in reserved.split():
            self.words[w] = self.id(g.mask(w, "IDENT", "WILD", "NAMEISH"))
        for w in contextual.split():
            self.words[w] = self.id(name | g.bit(w))
        for kind, listed in (words or {}).items():
            for w in listed.split():
                self.words[w] = self.id(g.mask(kind, "IDENT", "WILD"))
        if fold_case:
            known = {t for t in g.bits if t.isalpha() and t.isupper()} - {"NAME", "IDENT", "WILD", "NAMEISH", "NUM", "STR", "PARAM", "OP", "UNARY", "CMP"}
            for w in known - set(self.words):
                self.words[w] = self.id(name | g.bit(w))
        self.punctuation: dict[str, int] = {}
        for kind, listed in (punctuation or {}).items():
            for w in listed.split():
                self.punctuation[w] = self.id(g.bit(kind if kind else w) | g.bit("WILD"))
        self.name = self.id(name)
        self.num, self.str, self.template, self.regex, self.private = (self.id(g.mask(t, "WILD")) for t in ("NUM", "STR", "TEMPLATE", "REGEX", "PRIVATE"))
        self.comma, self.semicolon = self.punctuation.get(",", -1), self.punctuation.get(";", -1)
        self.brace = g.bit("{")

    def id(self, mask: int) -> int:
        known = self.ids.get(mask)
        if known is None:
            known = self.ids[mask] = len(self.masks)
            self.masks.append(mask)
        return known

    def with_nl(self, token: int) -> int:
        return self.id(self.masks[token] | NL)

    def derives(self, tokens: tuple, starts: tuple[str, ...]) -> list[str]:
        return self.grammar.accepted([self.masks[t] for t in tokens], starts)

    def piece(self, tokens: tuple) -> int:
        """Bits of all piecewise constructs that the piece may be part of."""
        known = self.piece_memo.get(tokens)
        if known is None:
            if len(self.piece_memo) > MEMO:
                self.piece_memo.clear()
            starts = tuple(dict.fromkeys(s for _, s in self.pieces))
            found = set(self.derives(collapsed(tokens, self.comma), starts)) if tokens else set(starts)
            known = self.piece_memo[tokens] = sum(self.grammar.bit(t) for t, s in self.pieces if s in found)
        return known

    def group(self, kind: str, pieces: list[tuple]) -> int:
        """The token of a closed bracket group."""
        whole = len(pieces) == 1 or not any(self.semicolon in p for p in pieces)
        key = (kind, *pieces)
        known = self.group_memo.get(key)
        if known is not None:
            return known
        mask = self.grammar.bit("WILD")
        if whole:
            tokens = collapsed(tuple(t for p in pieces for t in p), self.comma)
            found = set(self.derives(tokens, tuple(dict.fromkeys(s for _, s in self.groups[kind]))))
            mask |= sum(self.grammar.bit(t) for t, s in self.groups[kind] if s in found)
            if not tokens:
                mask |= self.grammar.bit("[empty]" if kind == "[" else "(empty)")
        if kind == "{":
            mask |= self.brace
            every = -1
            for p in pieces:
                every &= self.piece(p)
            if "{switch}" in self.grammar.bits and pieces and pieces[0]:
                first = self.masks[pieces[0][0]]
                if not first & (self.grammar.bit("case") | self.grammar.bit("default")):
                    every &= ~self.grammar.bit("{switch}")
            mask |= every & sum(self.grammar.bit(t) for t, _ in self.pieces)
        if not mask & ~(self.grammar.bit("WILD") | self.brace) and "[any]" not in self.grammar.bits:
            raise Rejected(kind)
        known = self.id(mask)
        if len(self.group_memo) > MEMO:
            self.group_memo.clear()
        if len(key) < 40:
            self.group_memo[key] = known
        return known


_SLASH_AFTER_BRACE = re.compile(r"\}\s*/(?![/*])")
_CLASS_NAMES = re.compile(r"\b(?:class|enum|record)\s+([A-Za-z_$][\w$]*)")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_STRING = r""""(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"""
_BLOCK_COMMENT = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_NUMBER = r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?"
_BLANK, _LINES, _WORD, _NUM, _STR, _OPEN, _CLOSE, _PUNCT, _TICK = range(1, 10)


class Braced(Language):
    """JavaScript, TypeScript and Java."""

    # a piece that goes on although a block or a semicolon stands before it
    def __init__(self, java: bool = False, typescript: bool = False):
        if java:
            super().__init__(G.JAVA, G.JAVA_GROUPS, G.JAVA_PIECES + (("{unit}", "Unit"),), G.JAVA_RESERVED, G.JAVA_CONTEXTUAL, G.JAVA_WORDS, G.JAVA_PUNCTUATION)
            punctuation, strings, number = G.JAVA_PUNCTUATION, r'"""[^\\"]*(?:(?:\\[\s\S]|"(?!""))[^\\"]*)*"""|' + _STRING.replace(r"\\(?:\r\n|[\s\S])", r"\\."), _NUMBER + "[lLfFdD]?"
            self.starts = ("{unit}",)
        else:
            keep, drop = ("TS: ", "JS: ") if typescript else ("JS: ", "TS: ")
            text = "\n".join(x.removeprefix(keep) for x in G.SCRIPT.splitlines() if not x.startswith(drop))
            groups = {k: tuple(x for x in v if typescript or x[1] not in ("Type", "Tuple", "Signature", "Mapped", "TypeMembers", "Enum")) for k, v in G.SCRIPT_GROUPS.items()}
            pieces = tuple(x for x in G.SCRIPT_PIECES if typescript or x[0] not in ("{iface}", "{module}")) + (("{script}", "Stmts"), ("{modulefile}", "Module"))
            super().__init__(text, groups, pieces, G.SCRIPT_RESERVED, G.SCRIPT_CONTEXTUAL, None, G.SCRIPT_PUNCTUATION, nl=True)
            if not typescript:  # names in scripts that are not strict
                for w in G.SCRIPT_SLOPPY.split():
                    self.words[w] = self.id(self.masks[self.words[w]] | self.grammar.bit("NAME"))
            punctuation, strings, number = G.SCRIPT_PUNCTUATION, _STRING, _NUMBER + "n?"
            self.starts = ("{script}", "{modulefile}")
        self.java = java
        marks = _alternation(w for x in punctuation.values() for w in x.split())
        comments = r"//[^\n]*|" + _BLOCK_COMMENT
        self.match = re.compile(
            rf"([ \t\r\f\v\u00a0\ufeff]+|//[^\n]*)|((?:\n[ \t\r]*|{_BLOCK_COMMENT})+)|([A-Za-z_$\u0080-\uffff][\w$]*)|((?:{number})(?![\w$]))|({strings})|([(\[{{])|([)\]}}])|({marks}|\#[A-Za-z_$][\w$]*)|(`)"
        ).match
        self.chunk = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match
        self.regex_literal = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*").match
        word = lambda *w: {self.words[x] for x in w if x in self.words}
        values = word("this", "super", "null")
        self.values = values | {self.name, self.num, self.str, self.template, self.regex} | {self.words[w] for w in (G.JAVA_CONTEXTUAL if java else G.SCRIPT_CONTEXTUAL).split()}
        self.goes_on = word("else", "catch", "finally", "while", "in", "instanceof", "as", "satisfies", "extends", "implements", "from", "of", "is", "permits", "throws")
        self.do = word("do")
        self.headers = word("if", "while", "for", "with") if not java else set()
        self.quiet = {self.punctuation[x] for x in (";", ",", "=", "=>", ".", "?", ":", "->", "::", "&", "|") if x in self.punctuation}
        # in Java, a name that a class of the file bears: only these can be constructors
        self.class_name = self.id(self.masks[self.name] | self.grammar.bit("CLASSNAME")) if java else self.name
        self.values |= {self.class_name}
        # a `>` that another follows at once: part of a shift, or of closing type arguments
        self.joined = self.id(self.grammar.mask(">", ">~", "WILD"))

    def judge(self, text: str) -> None:
        """Raises Rejected if no dialect accepts the text. A slash behind a closing brace divides or begins a regular expression:
        both readings are tried."""
        try:
            self._judge(text, False)
        except Rejected:
            if self.java or not _SLASH_AFTER_BRACE.search(text):
                raise
            self._judge(text, True)

    def _judge(self, text: str, regex_after_brace: bool) -> None:
        match, words, name_id, masks, semicolon = self.match, self.words, self.name, self.masks, self.semicolon
        values, goes_on, quiet, java, punctuation = self.values, self.goes_on, self.quiet, self.java, self.punctuation
        nl_ids: dict[int, int] = {}
        classes = set(_CLASS_NAMES.findall(text)) if java else ()
        pos, n = 0, len(text)
        if text.startswith("#!") and not java:
            pos = text.find("\n") if "\n" in text else n
        kind, pieces, now = "{", [], []
        stack: list[tuple[str, list, list, bool, bool]] = []
        broke, last, after_block, pending = False, -1, False, False
        while pos < n:
            m = match(text, pos)
            if m is None:
                raise Rejected("character")
            what, end = m.lastindex, m.end()
            if what == 1:
                pos = end
                continue
            if what == 2:
                if "\n" in m[2]:
                    broke = True
                pos = end
                continue
            if what == 3:
                token = words.get(m[3], name_id)
                if java and token == name_id and m[3] in classes:
                    token = self.class_name
            elif what == 8:
                mark = m[8]
                if mark[0] == "/" and last not in values and not java:
                    r = self.regex_literal(text, pos)
                    if r is None:
                        raise Rejected("regex")
                    token, end = self.regex, r.end()
                else:
                    token = self.joined if mark == ">" and text.startswith(">", end) else punctuation.get(mark)
                    if token is None:
                        if java:
                            raise Rejected("character")
                        token = self.private
            elif what == 4:
                token = self.num
            elif what == 5:
                token = self.str
            else:
                token = -1
            if pending or (after_block and (broke or java)):
                if kind == "{" and now and token not in goes_on and what != 7 and (pending or (what == 3) or (java and mark_is_at(m))):
                    if not (now[0] in self.do and pending is False):
                        pieces.append(tuple(now))
                        now = []
                pending = after_block = False
            after_block = False
            if what == 6:
                header = last in self.headers and not (len(now) > 1 and now[-2] == self.punctuation.get("."))
                stack.append((kind, pieces, now, broke and last not in quiet, header))
                kind, pieces, now, last, broke = m[6], [], [], -1, False
                pos = end
                continue
            if what == 9:
                if java:
                    raise Rejected("character")
                end = self.chunk(text, end).end()
                if text.startswith("`", end):
                    token, end = self.template, end + 1
                elif text.startswith("${", end):
                    stack.append((kind, pieces, now, broke and last not in quiet, False))
                    kind, pieces, now, last, broke = "`", [], [], -1, False
                    pos = end + 2
                    continue
                else:
                    raise Rejected("template")
            elif what == 7:
                close = m[7]
                if not stack:
                    raise Rejected("bracket")
                if close == "}" and kind == "`":
                    if "Expr" not in self.derives_cached(tuple(now)):
                        raise Rejected("template")
                    end = self.chunk(text, end).end()
                    if text.startswith("${", end):
                        pieces, now, last, broke = [], [], -1, False
                        pos = end + 2
                        continue
                    if not text.startswith("`", end):
                        raise Rejected("template")
                    kind, pieces, now, broke, _ = stack.pop()
                    token, end, begins = self.template, end + 1, False
                else:
                    if _CLOSES[close] != kind:
                        raise Rejected("bracket")
                    if now:
                        pieces.append(tuple(now))
                    token = self.group(kind, pieces)
                    after_block = kind == "{"
                    kind, pieces, now, broke, begins = stack.pop()
                    begins |= close == "}" and regex_after_brace
                if broke and not java:
                    token = self.with_nl(token)
                now.append(token)
                last, broke, pos = -1 if begins else self.str, False, end
                continue
            last = token
            if broke:
                if not java and now and now[-1] not in quiet:
                    marked = nl_ids.get(token)
                    if marked is None:
                        marked = nl_ids[token] = self.with_nl(token)
                    token = marked
                broke = False
            now.append(token)
            if token == semicolon and kind == "{":
                pending = True
            pos = end
        if stack:
            raise Rejected("open")
        if now:
            pieces.append(tuple(now))
        every = sum(self.grammar.bit(t) for t in self.starts)
        for p in pieces:
            every &= self.piece(p)
            if not every:
                raise Rejected("piece")

    def derives_cached(self, tokens: tuple) -> list[str]:
        key = ("`", tokens)
        known = self.group_memo.get(key)
        if known is None:
            known = self.group_memo[key] = self.derives(tokens, ("Expr",))
        return known


def mark_is_at(m: re.Match) -> bool:
    return m.lastindex == 8 and m[8] == "@"


class Sql(Language):
    def __init__(self):
        super().__init__(G.SQL, G.SQL_GROUPS, (("{file}", "Stmt"),), G.SQL_RESERVED, fold_case=True, punctuation={"CMP": "<> != <= >= ==  ~* !~ !~* ~~ <=>", "OP": "|| -> ->> #> #>> % & | ^ << >> @> <@ && ?", "": "=> :: = < > + - * / . , ; :"})
        self.unary = {"~": self.id(self.grammar.mask("UNARY", "CMP", "WILD"))}
        self.punctuation |= self.unary
        self.param = self.id(self.grammar.mask("PARAM", "WILD"))
        marks = _alternation(self.punctuation)
        self.match = re.compile(
            rf"(\s+|--[^\n]*|{_BLOCK_COMMENT})|([A-Za-z_\u0080-\uffff][\w$]*)|((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w]))|([eEnNbBxX]?'(?:[^'\\]|''|\\[\s\S])*'|\$(\w*)\$[\s\S]*?\$\5\$)|(\"(?:[^\"]|\"\")*\"|`[^`]*`)|([(\[])|([)\]])|(\$\d+|:[A-Za-z_]\w*|\?|@@?\w+|\{{\{{[^}}]*\}}\}})|({marks})"
        ).match

    def judge(self, text: str) -> None:
        match, words, name_id, punctuation = self.match, self.words, self.name, self.punctuation
        pos, n, kind, now, stack = 0, len(text), "", [], []
        upper: dict[str, int] = {}
        text = text.removeprefix("\ufeff")
        n = len(text)
        while pos < n:
            m = match(text, pos)
            if m is None:
                raise Rejected("character")
            what, pos = m.lastindex, m.end()
            if what == 1:
                continue
            if what == 2:
                token = upper.get(m[2])
                if token is None:
                    token = upper[m[2]] = words.get(m[2].upper(), name_id)
            elif what in (4, 5):
                token = self.str
            elif what == 3:
                token = self.num
            elif what == 6:
                token = name_id
            elif what == 7:
                stack.append((kind, now))
                kind, now = m[7], []
                continue
            elif what == 8:
                if _CLOSES[m[8]] != kind:
                    raise Rejected("bracket")
                token = self.group(kind, [tuple(now)])
                kind, now = stack.pop()
            elif what == 9:
                token = self.param
            else:
                token = punctuation[m[10]]
                if token == self.semicolon:
                    if stack:
                        raise Rejected("bracket")
                    if now and not self.piece(tuple(now)):
                        raise Rejected("statement")
                    now = []
                    continue
            now.append(token)
        if stack or (now and not self.piece(tuple(now))):
            raise Rejected("statement")


class Python(Language):
    def __init__(self):
        super().__init__(G.PYTHON, G.PYTHON_GROUPS, (), G.PYTHON_RESERVED, G.PYTHON_CONTEXTUAL, None, G.PYTHON_PUNCTUATION)
        self.suite_memo: dict[tuple, int] = {}
        self.line_memo: dict[tuple, int] = {}
        marks = _alternation(w for x in G.PYTHON_PUNCTUATION.values() for w in x.split())
        prefix = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
        body3 = r"""(?:\"{3}[^\\"]*(?:(?:\\[\s\S]|"(?!""))[^\\"]*)*\"{3}|'{3}[^\\']*(?:(?:\\[\s\S]|'(?!''))[^\\']*)*'{3}|"(?!"")(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')"""
        number = r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])"
        self.match = re.compile(rf"([ \t\f]+|\\\r?\n|\#[^\n]*)|(\r?\n)|({prefix}{body3})|((?:[fFtT][rR]?|[rR][fFtT])(?:\"{{3}}|'{{3}}|\"|'))|([A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*)|((?:{number})(?:(?!\w)|(?=(?:and|else|for|if|in|is|not|or)\b)))|([(\[{{])|([)\]}}])|({marks})").match
        self.blank = re.compile(r"(?:[ \t\f]*(?:\#[^\n]*)?\r?\n)+").match
        self.indent = re.compile(r"[ \t\f]*").match
        self.kinds = tuple(G.PYTHON_LINES.items())
        self.newline = self.grammar.bit("LINE")
        self.raw_text = re.compile(r"(?:[^{}\"'\n\\]|\{\{|\}\})+").match
        self.escape = re.compile(r"N\{[^{}\n]*\}|\r\n|[\s\S]").match
        self.space = re.compile(r"(?:\s|#[^\n]*)*").match
        self.conversion = re.compile(r"![ \t]*[A-Za-z_]\w*\s*").match

    def line(self, tokens: tuple) -> int:
        known = self.line_memo.get(tokens)
        if known is None:
            if len(self.line_memo) > MEMO:
                self.line_memo.clear()
            found = set(self.derives(collapsed(tokens, self.comma), tuple(s for _, s in self.kinds)))
            known = sum(self.grammar.bit(t) for t, s in self.kinds if s in found)
            known = self.line_memo[tokens] = self.id(known) if known else -1
        if known < 0:
            raise Rejected("line")
        return known

    def suite(self, lines: tuple, start: str = "Suite") -> int:
        known = self.suite_memo.get((start, lines))
        if known is None:
            if len(self.suite_memo) > MEMO:
                self.suite_memo.clear()
            ok = self.derives(lines, (start, "Cases") if start == "Suite" else (start,))
            mask = self.grammar.bit("SUITE") * (start in ok) | self.grammar.bit("CASES") * ("Cases" in ok)
            known = self.id(mask) if mask else -1
            if len(lines) < 60:
                self.suite_memo[start, lines] = known
        if known < 0:
            raise Rejected("suite")
        return known

    def _shrunk(self, lines: list[int]) -> tuple:
        """Simple lines in a row count as three."""
        out: list[int] = []
        for t in lines:
            if len(out) >= 3 and out[-1] == out[-2] == out[-3] == t and self.masks[t] == self.newline:
                continue
            out.append(t)
        return tuple(out)

    def _formatted(self, text: str, pos: int, head: str) -> int:
        """The end of an f-string whose content begins at pos; every replacement field is recognised as an expression."""
        quote = head.lstrip("rRfFtT")
        raw, one_line = len(head) - len(quote) > 1, len(quote) == 1
        while True:
            if m := self.raw_text(text, pos):
                pos = m.end()
            if text.startswith(quote, pos):
                return pos + len(quote)
            c = text[pos : pos + 1]
            if c == "{":
                pos = self._field(text, pos + 1, quote)
            elif c == "\\":
                if raw:  # the backslash stays, but a quote after it doesn't end the string
                    pos += 2 if text[pos + 1 : pos + 2] in ("\\", "\"", "'", "\n") and pos + 1 < len(text) else 1
                elif m := self.escape(text, pos + 1):
                    pos = pos + 1 if m[0] in "{}" else m.end()
                else:
                    raise Rejected("field")
            elif not c or c == "}" or (c == "\n" and one_line):
                raise Rejected("field")
            else:
                pos += 1

    def _field(self, text: str, pos: int, quote: str) -> int:
        """The position behind the brace that closes the replacement field whose expression begins at pos."""
        match, kind, now, stack = self.match, "", [], []
        while True:
            c = text[pos : pos + 1]
            if not stack and c and c in "}:!=" and text[pos : pos + 2] not in ("!=", "=="):
                break
            m = match(text, pos)
            if m is None:
                raise Rejected("field")
            what, pos = m.lastindex, m.end()
            if what <= 2:
                continue
            if what == 7:
                stack.append((kind, now))
                kind, now = m[7], []
                continue
            if what == 8:
                if not stack or _CLOSES[m[8]] != kind:
                    raise Rejected("bracket")
                token = self.group(kind, [tuple(now)])
                kind, now = stack.pop()
            elif what == 4:
                token, pos = self.str, self._formatted(text, pos, m[4])
            else:
                token = self._token(what, m)
            now.append(token)
        key = ("f", tuple(now))
        known = self.group_memo.get(key)
        if known is None:
            known = self.group_memo[key] = bool(self.derives(tuple(now), ("Field",)))
        if not known:
            raise Rejected("field")
        if text[pos] == "=":
            pos = self.space(text, pos + 1).end()
        if text.startswith("!", pos):
            m = self.conversion(text, pos)
            if not m:
                raise Rejected("field")
            pos = m.end()
        if text.startswith(":", pos):
            pos += 1
            while not text.startswith("}", pos):
                if text.startswith("{", pos):
                    pos = self._field(text, pos + 1, quote)
                elif pos >= len(text) or text.startswith(quote, pos) or (text[pos] == "\n" and len(quote) == 1):
                    raise Rejected("field")
                else:
                    pos += 1
        if not text.startswith("}", pos):
            raise Rejected("field")
        return pos + 1

    def _token(self, what: int, m: re.Match) -> int:
        """The token of a literal, name, number or mark."""
        if what == 3:
            return self.str
        if what == 5:
            name = m[5]
            if not name.isascii() and not name.isidentifier() and not unicodedata.normalize("NFKC", name).isidentifier():
                raise Rejected("character")
            return self.words.get(name, self.name)
        return self.num if what == 6 else self.punctuation[m[9]]

    def judge(self, text: str) -> None:
        text = text.removeprefix("\ufeff")
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if not text.endswith("\n"):
            text += "\n"
        match, blank, words, name_id = self.match, self.blank, self.words, self.name
        pos, n = 0, len(text)
        indents, blocks = [""], [[]]
        stack: list[tuple[str, list]] = []
        kind, now, fresh = "", [], True
        while pos < n:
            if fresh and not stack:
                if m := blank(text, pos):
                    pos = m.end()
                    if pos >= n:
                        break
                m = self.indent(text, pos)
                own = m[0].rsplit("\f", 1)[-1]
                pos = m.end()
                if text.startswith("#", pos) or pos >= n:
                    if pos >= n:
                        break
                    pos = text.index("\n", pos) + 1
                    continue
                if own != indents[-1]:
                    if own.startswith(indents[-1]):
                        indents.append(own)
                        blocks.append([])
                    else:
                        while indents and indents[-1] != own:
                            if not indents[-1].startswith(own):
                                raise Rejected("indent")
                            indents.pop()
                            if not indents:
                                raise Rejected("indent")
                            inner = blocks.pop()
                            blocks[-1].append(self.suite(self._shrunk(inner)))
                fresh = False
            m = match(text, pos)
            if m is None:
                raise Rejected("character")
            what, pos = m.lastindex, m.end()
            if what == 1:
                continue
            if what == 2:
                if not stack:
                    if now:
                        blocks[-1].append(self.line(tuple(now)))
                        now = []
                    fresh = True
                continue
            if what == 7:
                stack.append((kind, now))
                kind, now = m[7], []
                continue
            if what == 8:
                if not stack or _CLOSES[m[8]] != kind:
                    raise Rejected("bracket")
                token = self.group(kind, [tuple(now)])
                kind, now = stack.pop()
            elif what == 4:
                token, pos = self.str, self._formatted(text, pos, m[4])
            elif what == 5 and m[5].isascii():
                token = words.get(m[5], name_id)
            else:
                token = self._token(what, m)
            now.append(token)
        if stack:
            raise Rejected("open")
        if now:
            blocks[-1].append(self.line(tuple(now)))
        while len(blocks) > 1:
            inner = blocks.pop()
            blocks[-1].append(self.suite(self._shrunk(inner)))
        self.suite(self._shrunk(blocks[0]), "File")


class Json(Language):
    _token = re.compile(r'([ \t\r\n]+)|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(true|false|null)(?!\w)|([\[{])|([\]}])|([,:])')

    def __init__(self):
        super().__init__(G.JSON, G.JSON_GROUPS, punctuation={"": ": ,"})
        self.word = self.id(self.grammar.bit("WORD"))

    def judge(self, text: str) -> None:
        match = self._token.match
        pos, n, kind, now, stack = 0, len(text), "", [], []
        while pos < n:
            m = match(text, pos)
            if m is None:
                raise Rejected("character")
            what, pos = m.lastindex, m.end()
            if what == 1:
                continue
            if what == 5:
                stack.append((kind, now))
                kind, now = m[5], []
                continue
            if what == 6:
                if _CLOSES[m[6]] != kind:
                    raise Rejected("bracket")
                token = self.group(kind, [collapsed(tuple(now), self.comma)])
                kind, now = stack.pop()
            else:
                token = self.str if what == 2 else self.num if what == 3 else self.word if what == 4 else self.punctuation[m[7]]
            now.append(token)
        if stack or "Value" not in self.derives(tuple(now), ("Value",)):
            raise Rejected("value")


class Toml(Language):
    _token = re.compile(
        r"([ \t]+|\#[^\n]*)|(\r?\n)|(\"{3}[^\\\"]*(?:(?:\\[\s\S]|\"(?!\"\"))[^\\\"]*)*\"{3,5}|'{3}[\s\S]*?'{3,5}|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')"
        r"|([+-]?(?:inf|nan)(?![\w-])|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?(?![\w-])|\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?![\w-])|[+-]?(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|(?:0|[1-9][\d_]*)(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?)(?![\w-])|(?:true|false)(?![\w-]))"
        r"|([A-Za-z0-9_-]+)|([\[{])|([\]}])|([=.,])"
    )

    def __init__(self):
        super().__init__(G.TOML, G.TOML_GROUPS, punctuation={"": "= . ,"})
        bit = self.grammar.mask
        self.scalar, self.bare, self.double = self.id(bit("SCALAR", "BARE")), self.id(bit("BARE") | 0), self.id(bit("[[header]]", "[array]"))
        self.bare_key = self.id(bit("BARE") | self.grammar.bit("bare"))
        self.lines: dict[tuple, bool] = {}

    def judge(self, text: str) -> None:
        match = self._token.match
        pos, n, kind, now, stack = 0, len(text), "", [], []
        text = text.removeprefix("\ufeff") + "\n"
        n = len(text)
        value = False
        while pos < n:
            m = match(text, pos)
            if m is None:
                raise Rejected("character")
            what, end = m.lastindex, m.end()
            start, pos = pos, end
            if what == 1:
                continue
            if what == 2:
                if stack and kind == "{":
                    raise Rejected("line")
                if not stack:
                    if now and not self._line(tuple(now)):
                        raise Rejected("line")
                    now, value = [], False
                continue
            if what == 3:
                token = self.str
            elif what == 4:
                token = self.scalar
            elif what == 5:
                if value and (not stack or kind == "["):
                    raise Rejected("value")
                token = self.bare
            elif what == 6:
                stack.append((kind, now, start))
                kind, now = m[6], []
                continue
            elif what == 7:
                if _CLOSES[m[7]] != kind:
                    raise Rejected("bracket")
                inner = collapsed(tuple(now), self.comma)
                kind_was = kind
                try:
                    token = self.group(kind, [inner])
                except Rejected:
                    raise Rejected("group") from None
                if kind_was == "[" and len(now) == 1 and self.masks[now[0]] & self.grammar.bit("[header]") and not value:
                    token = self.double
                kind, now, _ = stack.pop()
            else:
                token = self.punctuation[m[8]]
                if m[8] == "=" and not stack:
                    value = True
            now.append(token)
        if stack:
            raise Rejected("open")

    def _line(self, tokens: tuple) -> bool:
        known = self.lines.get(tokens)
        if known is None:
            known = self.lines[tokens] = bool(self.derives(collapsed(tokens, self.comma), ("Line",)))
        return known


class Ini(Language):
    _blank = re.compile(r"\s*(?:[#;].*)?$")
    _section = re.compile(r"\s*\[[^\]\n]+\]\s*(?:[#;].*)?$")
    _entry = re.compile(r"\s*([^=:\[\]#;\s<>|][^=:\n]*?)\s*([=:])(.*)$")
    _conflict = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)")

    def __init__(self):
        super().__init__(G.INI, {"(": (), "[": (), "{": ()})
        bit = self.grammar.bit
        self.section, self.key, self.equals, self.value = (self.id(bit(t)) for t in ("SECTION", "KEY", "EQUALS", "VALUE"))
        self.lines: dict[tuple, bool] = {}

    def judge(self, text: str) -> None:
        entry = False
        for line in text.removeprefix("\ufeff").splitlines():
            if self._blank.match(line):
                continue
            if self._conflict.match(line):
                raise Rejected("conflict")
            tokens: tuple = ()
            if self._section.match(line):
                tokens, entry = (self.section,), False
            elif m := self._entry.match(line):
                if m[3].strip()[:1] in ("\"", "'") and m[3].strip().count(m[3].strip()[0]) % 2:
                    raise Rejected("quote")
                tokens = (self.key, self.equals) + ((self.value,) if m[3].strip() else ())
                entry = True
            elif entry and line[:1] in " \t":
                continue  # a continued value
            ok = self.lines.get(tokens)
            if ok is None:
                ok = self.lines[tokens] = bool(self.derives(tokens, ("Line",)))
            if not ok:
                raise Rejected("line")


class Yaml(Language):
    """Block structure by indentation, flow collections by brackets; block and quoted scalars are consumed whole."""

    _plain = r"(?:[^\s,\[\]{}#&*!|>'\"%@`:?-]|[:?-](?=[^\s,\[\]{}]))"
    _flow = re.compile(
        r"(\s+(?:\#[^\n]*)?)|(\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*')|([\[{])|([\]}])|([&!][^\s,\[\]{}]*)|(\*[^\s,\[\]{}]+)|([,:])(?=[\s,\[\]{}\"']|$)|([,:])"
        r"|((?:[^\s,\[\]{}#&*!|>'\"%@`:]|:(?=[^\s,\[\]{}]))(?:[^,\[\]{}:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)\#)*)"
    )
    _key = re.compile(r"((?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*'|(?:[^\s\[\]{}#&*!|>'\"%@`,:?-]|[:?-](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)\#)*?|\*\S+|<<|\?(?=\s).*?|\{\{[^}\n]*\}\}.*?))[ \t]*:(?=[ \t\r]|$)")
    _props = re.compile(r"(?:(?:&\S+|!\S*)(?:[ \t]+|$))+")
    _block = re.compile(r"[|>](?:[1-9][+-]?|[+-][1-9]?)?[ \t]*(?:[ \t]#.*)?$")
    _comment = re.compile(r"(?:^|[ \t])#.*$")
    _bad_start = re.compile(r"[@`%]|[,\]}](?!\S)|[\]},]|\t")
    _inner_colon = re.compile(r":(?:[ \t]|$)")

    def __init__(self):
        super().__init__(G.YAML, G.YAML_GROUPS, punctuation={"": ": ,"})
        g = self.grammar
        self.tokens = {t: self.id(g.bit(t)) for t in "KEYVALUE KEYONLY KEYPROPS KEYBLOCK BLOCKTEXT MERGE NESTED SEQSAME SCALAR FLOW DASHSCALAR DASHONLY DASHMAP DASHBLOCK PLAIN STR ANCHOR ALIAS".split()}
        self.memo: dict[tuple, bool] = {}

    def _accepts(self, lines: list[int]) -> bool:
        out: list[int] = []
        for t in lines:
            if len(out) >= 3 and out[-1] == out[-2] == out[-3] == t:
                continue
            out.append(t)
        key = tuple(out)
        ok = self.memo.get(key)
        if ok is None:
            ok = self.memo[key] = bool(self.derives(key, ("Document",)))
        return ok

    def _skip_flow(self, text: str, pos: int) -> int:
        """The end of a flow collection that begins at pos."""
        match, now, kind, stack = self._flow.match, [], "", []
        while True:
            m = match(text, pos)
            if m is None or pos >= len(text):
                raise Rejected("flow")
            what, pos = m.lastindex, m.end()
            if what == 1:
                continue
            if what == 3:
                stack.append((kind, now))
                kind, now = m[3], []
                continue
            if what == 4:
                if not stack or _CLOSES[m[4]] != kind:
                    raise Rejected("bracket")
                token = self.group(kind, [collapsed(tuple(now), self.comma)])
                kind, now = stack.pop()
                if not stack:
                    return pos
            elif what in (7, 8):
                mark = m[7] or m[8]
                if mark == ":" and what == 8 and not (now and now[-1] == self.str):
                    raise Rejected("colon")
                token = self.punctuation[mark]
            else:
                token = {2: self.str, 5: self.tokens["ANCHOR"], 6: self.tokens["ALIAS"], 9: self.tokens["PLAIN"]}[what]
            now.append(token)

    _quote = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'")

    def _value(self, text: str, pos: int, indent: int) -> tuple[str, int]:
        """Kind and end of a value that begins at pos: BLOCK, NONE, QUOTED, FLOW or PLAIN; end is a line's end."""
        end = text.find("\n", pos)
        end = len(text) if end < 0 else end
        rest = text[pos:end].rstrip("\r")
        if m := self._props.match(rest):
            pos += m.end()
            rest = rest[m.end() :]
            if not rest.strip() or rest[0] == "#":
                return "PROPS", end
        if not rest.strip() or rest.lstrip()[0] == "#":
            return "NONE", end
        first = rest[0]
        if self._block.match(rest):
            return "BLOCK", end
        if first in "|>":
            raise Rejected("block")
        if first in "\"'":
            m = self._quote.match(text, pos)
            if not m:
                raise Rejected("quote")
            return "QUOTED", self._rest_of_line(text, m.end())
        if first in "[{":
            if rest.startswith("{{") and "}}" in rest:
                raise Rejected("template")
            return "FLOW", self._rest_of_line(text, self._skip_flow(text, pos))
        if self._bad_start.match(rest):
            raise Rejected("start")
        if first == "*":
            return "PLAIN", end
        plain = self._comment.sub("", rest)
        if self._inner_colon.search(plain):
            raise Rejected("colon")
        if first in "-?:" and plain[1:2] in ("", " ", "\t"):
            raise Rejected("dash")
        return "PLAIN", end

    def _rest_of_line(self, text: str, pos: int) -> int:
        end = text.find("\n", pos)
        end = len(text) if end < 0 else end
        rest = text[pos:end].strip()
        if rest and not rest.startswith("#"):
            raise Rejected("after")
        return end

    def judge(self, text: str) -> None:
        text = text.removeprefix("\ufeff").replace("\r\n", "\n")
        T, pos, n = self.tokens, 0, len(text)
        levels: list[tuple[int, list[int]]] = [(-1, [])]
        plain_open = -1  # indent of the entry whose plain scalar may go on in deeper lines

        def close(upto: int) -> None:
            while levels[-1][0] > upto:
                indent, lines = levels.pop()
                if not self._accepts(lines):
                    raise Rejected("block")
                parent = levels[-1][1]
                if parent and parent[-1] != T["NESTED"]:
                    parent.append(T["NESTED"])
                elif levels[-1][0] >= 0:
                    raise Rejected("indent")
                else:
                    parent.append(T["NESTED"])

        def finish() -> None:
            close(-1)
            if len(levels[0][1]) > 1:
                raise Rejected("document")
            levels[0][1].clear()

        while pos < n:
            end = text.find("\n", pos)
            end = n if end < 0 else end
            line = text[pos:end]
            stripped = line.strip()
            if not stripped or stripped[0] == "#":
                pos = end + 1
                continue
            indent = len(line) - len(line.lstrip(" "))
            if indent == 0 and (stripped == "---" or stripped.startswith("--- ") or stripped == "..."):
                finish()
                plain_open = -1
                pos = end + 1
                continue
            if indent == 0 and line[0] == "%" and not levels[0][1] and len(levels) == 1:
                pos = end + 1
                continue
            if plain_open >= 0 and indent > plain_open:
                if self._inner_colon.search(self._comment.sub("", stripped)) and not stripped.startswith(("http:", "https:")):
                    raise Rejected("colon")
                pos = end + 1
                continue
            plain_open = -1
            if line[indent : indent + 1] == "\t":
                raise Rejected("tab")
            at = indent
            # a sequence may stand at its key's own indent
            dash = re.match(r"-(?=\s|$)", line[at:])
            if indent > levels[-1][0]:
                if levels[-1][0] >= 0 and levels[-1][1] and levels[-1][1][-1] not in (T["KEYONLY"], T["KEYPROPS"], T["DASHONLY"], T["DASHMAP"]):
                    raise Rejected("indent")
                levels.append((indent, []))
            elif indent < levels[-1][0]:
                close(indent)
                if levels[-1][0] != indent:
                    raise Rejected("indent")
            lines = levels[-1][1]
            if dash and lines and lines[-1] in (T["KEYONLY"], T["KEYPROPS"]):
                # sequence at the indent of its key: fold it as a level of its own
                levels.append((indent, []))
                lines = levels[-1][1]
            elif not dash and len(levels) > 2 and levels[-2][0] == indent and levels[-1][0] == indent:
                inner = levels.pop()[1]
                if not self._accepts(inner):
                    raise Rejected("block")
                lines = levels[-1][1]
                lines.append(T["SEQSAME"])
            while dash:
                at += 1
                gap = len(line[at:]) - len(line[at:].lstrip(" "))
                rest = line[at + gap :]
                if not rest.strip() or rest.lstrip()[0] == "#":
                    lines.append(T["DASHONLY"])
                    at = len(line)
                    break
                at += gap
                dash = re.match(r"-(?=\s|$)", line[at:])
                if dash or self._key.match(line, at):
                    lines.append(T["DASHMAP"])
                    levels.append((at, []))
                    lines, indent = levels[-1][1], at
                    continue
                kind, stop = self._value(text, pos + at, indent)
                if kind == "BLOCK":
                    lines.append(T["DASHBLOCK"])
                    stop = self._block_end(text, stop, indent)
                else:
                    lines.append(T["DASHSCALAR"] if kind not in ("NONE", "PROPS") else T["DASHONLY"])
                    plain_open = indent if kind == "PLAIN" else -1
                pos, at = stop + 1, -1
                break
            if at == -1:
                continue
            if at >= len(line):
                pos = end + 1
                continue
            key = self._key.match(line, at)
            if not key:
                if lines:
                    raise Rejected("key")
                kind, stop = self._value(text, pos + at, indent)
                if kind == "BLOCK":
                    stop = self._block_end(text, stop, indent - 1)
                lines.append(T["FLOW"] if kind == "FLOW" else T["SCALAR"])
                plain_open = max(indent - 1, 0) if kind == "PLAIN" else -1
                if kind == "PLAIN" and indent == 0 and levels[-1][0] == 0:
                    plain_open = -1
                pos = stop + 1
                continue
            value_at = key.end()
            value_at += len(line[value_at:]) - len(line[value_at:].lstrip(" \t"))
            kind, stop = self._value(text, pos + value_at, indent)
            if kind == "BLOCK":
                lines.append(T["KEYBLOCK"])
                stop = self._block_end(text, stop, indent)
            elif kind == "NONE":
                lines.append(T["KEYONLY"])
            elif kind == "PROPS":
                lines.append(T["KEYPROPS"])
            else:
                lines.append(T["KEYVALUE"])
                plain_open = indent if kind == "PLAIN" else -1
            pos = stop + 1
        finish()

    @staticmethod
    def _block_end(text: str, end: int, indent: int) -> int:
        """The end of the last line of a block scalar: blank lines and lines deeper than the key."""
        while end < len(text):
            stop = text.find("\n", end + 1)
            stop = len(text) if stop < 0 else stop
            line = text[end + 1 : stop]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            end = stop
        return end


# fixed values: extension to language
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".pyw": "python",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescript",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".java": "java", ".sql": "sql", ".psql": "sql", ".pgsql": "sql",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".ini": "ini",
}

_MAKERS: dict[str, Callable[[], Language]] = {
    "python": Python,
    "typescript": lambda: Braced(typescript=True),
    "javascript": Braced,
    "java": lambda: Braced(java=True),
    "sql": Sql,
    "yaml": Yaml,
    "json": Json,
    "toml": Toml,
    "ini": Ini,
}
_LANGUAGES: dict[str, Language] = {}


def reason(text: str | None, language: str | None) -> str | None:
    """Why every dialect of the language rejects the text; None if one accepts it or there is nothing to judge."""
    if text is None or not text.strip() or language not in _MAKERS:
        return None
    own = _LANGUAGES.get(language) or _LANGUAGES.setdefault(language, _MAKERS[language]())
    try:
        own.judge(text)
    except Rejected as why:
        return str(why)
    return None


def _judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, extension, content) to (file_id, reason)."""
    for batch in batches:
        why = [reason(text, EXTENSIONS.get((e or "").lower())) for e, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        rejected = pa.array([w is not None for w in why])
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(rejected), pa.array([w for w in why if w is not None], pa.string())], ["file_id", "reason"])


def rejected_files(files: DataFrame) -> DataFrame:
    """(file_id, reason): one row per rejected file."""
    own = files.where("file_id is not null and content is not null").where(F.lower("extension").isin(*EXTENSIONS)).select("file_id", "extension", "content")
    kind = own.schema["file_id"].dataType.simpleString()
    return spread(own).mapInArrow(_judged, f"file_id {kind}, reason string").groupBy("file_id").agg(F.min("reason").alias("reason"))


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id): files that no dialect of their extension's language accepts."""
    return rejected_files(files).select("file_id")


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, share): of the files that a grammar exists for; language by extension."""
    language = F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair]), F.lower("extension"))
    own = files.where("file_id is not null").select("file_id", "repo", language.alias("language")).where("language is not null").dropDuplicates(["file_id"])
    flagged = own.join(invalid_files(files).withColumn("bad", F.lit(1)), "file_id", "left")
    out = flagged.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("bad").alias("invalid"))
    return out.withColumn("share", F.round(F.col("invalid") / F.col("files"), 6))
