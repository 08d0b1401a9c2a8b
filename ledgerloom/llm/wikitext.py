"""Plain words and sentences of pages in wiki markup (run inside Arrow batches)."""

from __future__ import annotations

import html
import re

_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_QUOTE = re.compile(r"\{\{\s*(?:block|c)?quot(?:e|ation)\s*\|\s*(?:text\s*=|1\s*=)?", re.I)
_QUOTE_END = re.compile(r"\|\s*(?:source|author|title|sign|2)\s*=[^{}|]*(?=\||\}\})", re.I)
_PARAMETER = re.compile(r"\{\{\{[^{}]*\}\}\}")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_CATEGORY = re.compile(r"\[\[\s*:?(?:category|catégorie|kategorie|categoría|file|image|datei|fichier|archivo)\s*:[^\[\]]*\]\]", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_TABLE_START = re.compile(r"^\s*\{\|.*$", re.M)
_BRACES = re.compile(r"\{\{|\}\}")
_WORD = re.compile(r"[^\W_]+")


def strip_templates(text: str) -> str:
    """Without templates, however nested; the words of quotation templates stay."""
    if "uot" in text or "UOT" in text:
        opened = _QUOTE.sub("\x02", text)
        if opened != text:
            # the rest of the call goes, its closing braces become a space
            text = re.sub(r"\x02((?:[^{}\x02]|\{\{[^{}]*\}\})*?)\}\}", lambda m: " " + _QUOTE_END.sub(" ", m.group(1) + "}}").replace("}}", " "), opened).replace("\x02", " ")
    # innermost ones first; deep nests, which would take a pass each, go in one
    for _ in range(8):
        bare = _TEMPLATE.sub(" ", _PARAMETER.sub(" ", text) if "{{{" in text else text)
        if bare == text:
            return text
        text = bare
    return _strip_nests(text)


def _strip_nests(text: str) -> str:
    """Without what stands between matching pairs of double braces; braces without a partner stay."""
    opened: list[int] = []
    kept: list[str] = []
    at = 0
    for mark in _BRACES.finditer(text):
        kept.append(text[at : mark.start()])
        at = mark.end()
        if mark.group() == "{{":
            opened.append(len(kept))
            kept.append("{{")
        elif opened:
            del kept[opened.pop() :]
            kept.append(" ")
        else:
            kept.append("}}")
    kept.append(text[at:])
    return "".join(kept)


def plain(text: str) -> str:
    """Text without references, templates, tags, link targets, categories and invisible characters; hidden comments stay."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "<ref" in text or "<REF" in text:
        text = _REF.sub(" ", text)
    if "{{" in text:
        text = strip_templates(text)
    if "[[" in text:
        text = _LINK.sub(r"\1", _CATEGORY.sub(" ", text))
    if "<" in text:
        text = _TAG.sub("", text.replace("<!--", " ").replace("-->", " "))
    if "{|" in text:
        text = _TABLE_START.sub(" ", text)
    if "''" in text:
        text = text.replace("'''", "").replace("''", "")
    if "&" in text:
        text = html.unescape(text)
        if not text.isascii():
            text = _INVISIBLE.sub("", text)
    return text


def word_list(text: str) -> list[str]:
    """Lower-case words of the plain text."""
    return _WORD.findall(plain(text).lower())
