"""Parsing of Elixir sources: table generator, grammar and text normalisation."""

from __future__ import annotations

from functools import lru_cache

from . import elixir, lalr

_GRAMMARS = {"elixir": elixir}


@lru_cache(maxsize=None)
def tables(lang: str) -> lalr.Tables:
    """The parse tables of a language, generated once per process from its grammar."""
    return lalr.Tables(_GRAMMARS[lang].GRAMMAR)


def normal(text: str | None) -> str:
    """Text with one kind of line end and without a byte-order mark; null counts as empty."""
    return (text or "").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
