"""Subject areas of documents.

Curated subject terms (a file given as a parameter), and terms learned from a bounded sample of labelled documents, are matched by one Aho-Corasick
automaton over the page's own sentences and table rows. Each sentence goes to the subjects whose terms weigh most in it, a
term weighing the more the rarer it is in the corpus; a document's score for a subject is the share of
its sentences, so that long and short pages compare. Every subject over the threshold is assigned.

The corpus is read once: the matches are written to the checkpoint folder, document frequencies
are counted over all documents from there, and the scores are worked out from the same rows. Neither step
moves a text through a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import wikitext
from ledgerloom.session import cut

TERMS = str(Path(__file__).with_name("subject_terms.tsv"))

#: The share of a page's own sentences a subject needs; a third, less what cross-topic words take off on labelled pages.
THRESHOLD = 0.28
HALF = 0.5  # weight of a term at home in several subjects
_SHIFT = 1 << 16  # terms per lexicon
SAMPLE = 20_000  # labelled documents that terms are learned from
LEAST_DOCUMENTS = 4  # labelled documents a learned term occurs in
LEAST_SHARE = 0.5  # of their labels that must be of its subject
MOST_LEARNED = 20_000  # learned terms, the most telling first

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REDIRECT = re.compile(r"^\s*#\s*\w*(?:redir|weiterleitung)\w*", re.I)
_HEADING = re.compile(r"^=+[^=].*=+\s*$")
_SENTENCE = re.compile(r"[^.!?…]*[.!?…]+")
_NOTICE = re.compile(r"^\s*''[^'].*[^']''\s*$")


@cache
def load_terms(path: str = TERMS) -> list[tuple[str, str, float]]:
    """(term, subject, weight) rows of a term file; English terms also get a plural in s."""
    rows = []
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        subject, language, terms = line.split("\t")
        for term in terms.split():
            weight = HALF if term.endswith("*") else 1.0
            term = term.rstrip("*").lower()
            rows.append((term, subject, weight))
            if language == "en" and not term.endswith("s"):
                rows.append((term + "s", subject, weight))
    return rows


class Lexicon:
    """Terms numbered, with their subjects, and the automaton over them."""

    def __init__(self, rows: Iterable[tuple[str, str, float]]):
        self.subjects = sorted({s for _, s, _ in rows})
        by_term: dict[str, dict[str, float]] = {}
        for term, subject, weight in rows:
            held = by_term.setdefault(term, {})
            held[subject] = max(weight, held.get(subject, 0.0))
        self.terms = sorted(by_term)
        if len(self.terms) >= _SHIFT:
            raise ValueError("too many terms for one lexicon")
        self.weights = np.zeros((len(self.terms), len(self.subjects)))
        for i, term in enumerate(self.terms):
            for subject, weight in by_term[term].items():
                self.weights[i, self.subjects.index(subject)] = weight
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            built = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                built.add_word(term, (len(term), i))
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}


def own_sentences(text: str) -> list[str]:
    """The page's own sentences and table rows, without markup.

    Redirects have none. Left out: templates, references, comments, headings, categories, notices in italics,
    and loose words that end in no full stop.
    """
    if _REDIRECT.match(text):
        return []
    if "<!--" in text:
        text = _COMMENT.sub(" ", text)
    if not text.isascii():
        text = wikitext._INVISIBLE.sub("", text)
    if "<ref" in text or "<REF" in text:
        text = wikitext._REF.sub(" ", text)
    if "{{" in text:
        text = wikitext.strip_templates(text)
    if "[[" in text:
        text = wikitext._LINK.sub(r"\1", wikitext._CATEGORY.sub(" ", text))
    if "<" in text:
        text = wikitext._TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    out = []
    row: list[str] = []
    in_table = False
    for line in text.split("\n"):
        mark = line[:2]
        if mark == "{|":
            in_table = True
            continue
        if in_table:
            if mark in ("|-", "|}"):
                if row:
                    out.append(" ".join(row))
                    row = []
                in_table = mark != "|}"
                continue
            if mark[:1] == "!" or mark == "|+":
                continue
            if mark[:1] == "|":
                row.append(line[1:].replace("||", " "))
                continue
            if not line.strip():
                if row:
                    out.append(" ".join(row))
                    row = []
                in_table = False
                continue
        if not line or mark == "==" or line.isspace() or _HEADING.match(line):
            continue
        if mark == "''" and _NOTICE.match(line):
            continue
        out += _SENTENCE.findall(line)
    if row:
        out.append(" ".join(row))
    return [s for s in out if s.count(" ") >= 2 or len(s) > 24]


def _match(lexicon: Lexicon, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = lexicon.automaton()
    for batch in batches:
        counts, hits = [], []
        for text in batch["text"]:
            sentences = own_sentences(text)
            found: list[int] = []
            for number, sentence in enumerate(sentences):
                low = sentence.lower()
                last = len(low) - 1
                for end, (n, term) in automaton.iter(low):
                    if (end == last or not low[end + 1].isalpha()) and (end < n or not low[end - n].isalpha()):
                        found.append(number * _SHIFT + term)
            counts.append(len(sentences))
            hits.append(found)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_sentences": counts, "hits": hits})


def matches(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, n_sentences, hits`` of every document with text; a hit is sentence number and term in one integer."""
    corpus = documents.select("doc_id", "text").where(F.length("text") > 0)
    return corpus.mapInPandas(lambda batches: _match(lexicon, batches), "doc_id bigint, n_sentences int, hits array<bigint>")


def _score(weights: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_subjects = weights.shape[1]
    for batch in batches:
        hits = batch.column("hits")
        values = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pa.compute.list_value_length(hits).fill_null(0).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), lengths)
        # terms of one sentence stand together; number the sentences through the batch
        sentence = values // _SHIFT
        new = np.ones(len(values), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
        row = np.cumsum(new) - 1
        votes = np.zeros((int(new.sum()), n_subjects))
        np.add.at(votes, row, weights[values % _SHIFT])
        top = votes.max(axis=1, keepdims=True) if len(votes) else votes
        won = (votes >= top - 1e-9) & (votes > 0)
        share = won / np.maximum(won.sum(axis=1, keepdims=True), 1)
        per_doc = np.zeros((batch.num_rows, n_subjects))
        np.add.at(per_doc, doc[new], share)
        sentences = np.maximum(batch.column("n_sentences").to_numpy(zero_copy_only=False), 1)
        scores = per_doc / sentences[:, None]
        at, subject = np.nonzero(scores > 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at)), pa.array(subject.astype(np.int32)), pa.array(scores[at, subject])], names=["doc_id", "subject_no", "score"]
        )


_WORD = re.compile(r"[^\W\d_]{3,}")


def _label_words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple[str, str, float]] = []
        for text, subjects in zip(batch["text"], batch["subjects"], strict=True):
            words = {w for sentence in own_sentences(text) for w in _WORD.findall(sentence.lower())}
            rows += [(w, s, 1.0 / len(subjects)) for w in words for s in subjects]
        yield pd.DataFrame(rows, columns=["term", "subject", "part"])


def learn_terms(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_documents: int = LEAST_DOCUMENTS, least_share: float = LEAST_SHARE, most: int = MOST_LEARNED
) -> list[tuple[str, str, float]]:
    """(term, subject, weight) rows learned from labelled documents, ``documents(doc_id, text)`` and ``labels(doc_id, subject)``.

    A word stands for a subject where at least ``least_share`` of the labels of the documents that hold it, of which there are
    ``least_documents`` or more, are of that subject; its weight is that share. Labels of one document share its weight, repeated labels count
    once, null ids and subjects not at all. The model is fitted on ``sample`` labelled documents at most, chosen by a hash of the id, and holds
    ``most`` terms at most.
    """
    known = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of ids and subjects
    labelled = documents.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id").select("text", "subjects")
    counted = labelled.mapInPandas(_label_words, "term string, subject string, part double").groupBy("term", "subject").agg(F.sum("part").alias("part"))
    top = counted.groupBy("term").agg(F.max(F.struct("part", "subject")).alias("b"), F.sum("part").alias("n"))
    kept = top.where((F.col("n") >= least_documents) & (F.col("b.part") >= F.col("n") * least_share)).select("term", F.col("b.subject").alias("subject"), (F.col("b.part") / F.col("n")).alias("weight"), "n")
    return [(r.term, r.subject, r.weight) for r in kept.orderBy((F.col("weight") * F.log1p("n")).desc(), "term").limit(most).collect()]


def with_learned(curated: list[tuple[str, str, float]], learned: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Curated terms, and the learned ones they do not have."""
    have = {t for t, _, _ in curated}
    return curated + [row for row in learned if row[0] not in have]


def subject_scores(documents: DataFrame, terms: Iterable[tuple[str, str, float]] | None = None) -> DataFrame:
    """``doc_id, subject, score``: the share of each document's own sentences that each subject has.

    A sentence belongs to the subject with the greatest weight in it, ties in equal parts. A term's weight is its
    curated one times its rarity, log(1 + documents / documents with it), over the whole corpus. Null or empty
    texts, redirects and pages without own sentences give no rows; repeated documents repeat theirs.
    """
    lexicon = Lexicon(list(terms) if terms is not None else load_terms())
    found = cut(matches(documents, lexicon))
    # one row per term: at most as many as the lexicon has
    per_term = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: (h % _SHIFT).cast("int")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r.term: r.n for r in per_term.collect()}
    total = found.count()
    rarity = np.array([np.log1p(total / max(1, frequency.get(i, 0))) for i in range(len(lexicon.terms))])
    weights = lexicon.weights * rarity[:, None]
    names = F.array(*[F.lit(s) for s in lexicon.subjects])
    scored = found.mapInArrow(lambda batches: _score(weights, batches), "doc_id bigint, subject_no int, score double")
    return scored.select("doc_id", F.get(names, F.col("subject_no")).alias("subject"), "score")


def assign(documents: DataFrame, threshold: float = THRESHOLD, terms: Iterable[tuple[str, str, float]] | None = None) -> DataFrame:
    """``doc_id, subject, score`` for every subject whose score reaches the threshold."""
    return subject_scores(documents, terms).where(F.col("score") >= threshold)
