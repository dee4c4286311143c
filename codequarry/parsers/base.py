"""What every symbol extractor gives: symbols of one file's text."""

from __future__ import annotations

import dataclasses as D
from abc import ABC, abstractmethod


@D.dataclass
class Symbol:
    type: str
    name: str | None
    start_line: int
    end_line: int
    text: str
    signature: str | None = None
    doc_comment: str | None = None
    parent: str | None = None
    package: str | None = None
    imports: list[str] | None = None
    calls: list[str] | None = None


class Parser(ABC):
    """An extractor for some languages; pluggable."""

    languages: tuple[str, ...] = ()

    @abstractmethod
    def parse(self, text: str, path: str) -> list[Symbol]:
        """The file's symbols in the order of their first lines."""


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def file_symbol(text: str, path: str) -> Symbol:
    return Symbol("file", base_name(path), 1, text.count("\n") + 1, text)


def first_seen(values) -> list[str]:
    return list(dict.fromkeys(values))
