"""A generalised LL recogniser over token masks, with a graph-structured stack.

Grammars are written as text, one rule a line: `Name = alternatives`, with `|`, `( )`, `?`, `*`, `+`. Terminals are quoted
or all capitals; a token is a bit mask of all terminals that it can stand for, so contextual keywords and bracket groups
that several constructs may derive need no decision in the lexer. `<nl>` matches nothing but demands a line break before
the next token or the end; `!'x'` demands that the next token can't be 'x'.

Several start symbols (the grammars of several dialects, or all uses of a bracket group) run together on one stack: each
nonterminal at each position is one node, whatever asked for it.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"!?'[^']+'|<nl>|[A-Za-z_]\w*|[|()?*+]")
NL = 1  # bit 0 of a token mask: a line break stands before the token


class Grammar:
    def __init__(self, text: str):
        self.bits: dict[str, int] = {}
        self.rules: dict[str, list[list]] = {}
        self._extra = 0
        for line in text.strip().splitlines():
            line = line.strip()
            if line and not line.startswith("#"):
                name, _, body = line.partition("=")
                self.rules.setdefault(name.strip(), []).extend(self._alternatives(iter([*_TOKEN.findall(body), None])))
        self._compile()

    def bit(self, terminal: str) -> int:
        return self.bits.setdefault(terminal, 2 << len(self.bits))

    def mask(self, *terminals: str) -> int:
        out = 0
        for t in terminals:
            out |= self.bit(t)
        return out

    def _alternatives(self, tokens, closing=None) -> list[list]:
        out, now = [], []
        for t in tokens:
            if t == closing:
                break
            if t == "|":
                out.append(now)
                now = []
            elif t == "(":
                now.append(self._named(self._alternatives(tokens, ")")))
            elif t in ("?", "*", "+"):
                one = now.pop()
                if t == "?":
                    now.append(self._named([[one], []]))
                else:
                    many = self._named([])
                    self.rules[many] += [[one, many], []]
                    now += [one, many] if t == "+" else [many]
            else:
                now.append(t)
        return [*out, now]

    def _named(self, alternatives: list[list]) -> str:
        self._extra += 1
        name = f"_{self._extra}"
        self.rules[name] = alternatives
        return name

    def _compile(self) -> None:
        """Rules to flat code: positive: terminal bit, negative: nonterminal, tuples: predicates, None: end."""
        names = {n: k + 1 for k, n in enumerate(self.rules)}
        missing = set()

        def coded(s: str):
            if s == "<nl>":
                return ("nl", 0)
            if s.startswith("!'"):
                return ("not", self.bit(s[2:-1]))
            if s.startswith("'"):
                return self.bit(s[1:-1])
            if s in names:
                return -names[s]
            if s.isupper():
                return self.bit(s)
            missing.add(s)
            return 0

        self.names, self.code, self.alts = names, [], [None] * (len(names) + 1)
        firsts: list[list[tuple[int, list]]] = [[] for _ in range(len(names) + 1)]
        for name, alternatives in self.rules.items():
            for alt in alternatives:
                symbols = [coded(s) for s in alt]
                firsts[names[name]].append((len(self.code), symbols))
                self.code += [*symbols, None]
        if missing:
            raise ValueError(f"undefined: {sorted(missing)}")
        first, nullable = [0] * (len(names) + 1), [False] * (len(names) + 1)

        def of(symbols) -> tuple[int, bool]:
            mask = 0
            for s in symbols:
                if isinstance(s, tuple):
                    continue
                if s > 0:
                    return mask | s, False
                mask |= first[-s]
                if not nullable[-s]:
                    return mask, False
            return mask, True

        changed = True
        while changed:
            changed = False
            for n in range(1, len(names) + 1):
                for _, symbols in firsts[n]:
                    mask, empty = of(symbols)
                    if (mask | first[n]) != first[n] or (empty and not nullable[n]):
                        first[n] |= mask
                        nullable[n] |= empty
                        changed = True
        for n in range(1, len(names) + 1):
            self.alts[n] = [(slot, *of(symbols)) for slot, symbols in firsts[n]]

    def accepted(self, masks: list[int], starts: tuple[str, ...]) -> list[str]:
        """The start symbols that derive the whole sequence of token masks."""
        code, alts, n = self.code, self.alts, len(masks)
        masks = [*masks, 0]
        nodes: dict[tuple[int, int], tuple[set, list]] = {}
        work: list[tuple[int, int, tuple]] = []
        seen: set[tuple[int, int, int]] = set()

        def node(symbol: int, i: int):
            key = (symbol, i)
            found = nodes.get(key)
            if found is None:
                found = nodes[key] = (set(), [])
                look = masks[i]
                for slot, first, empty in alts[symbol]:
                    if empty or first & look:
                        work.append((slot, i, found))
            return found

        roots = [(s, node(self.names[s], 0)) for s in starts]
        while work:
            slot, i, own = work.pop()
            key = (slot, i, id(own))
            if key in seen:
                continue
            seen.add(key)
            while True:
                symbol = code[slot]
                if symbol is None:
                    if i not in own[0]:
                        own[0].add(i)
                        for back, parent in own[1]:
                            work.append((back, i, parent))
                    break
                if symbol.__class__ is tuple:
                    if (i < n and not masks[i] & NL) if symbol[0] == "nl" else masks[i] & symbol[1]:
                        break
                    slot += 1
                elif symbol > 0:
                    if not masks[i] & symbol:
                        break
                    i += 1
                    slot += 1
                else:
                    below = node(-symbol, i)
                    edge = (slot + 1, own)
                    below[1].append(edge)
                    for end in list(below[0]):
                        work.append((slot + 1, end, own))
                    break
        return [s for s, (ends, _) in roots if n in ends]
