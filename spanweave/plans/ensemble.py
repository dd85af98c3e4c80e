"""Ensemble inference analytics: parse -> locate -> vote -> format -> submission."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.text import parse_spans
from spanweave.operators.spans import (format_location, locate_spans, majority_vote,
                                       with_blank_edges)


def explode_spans(preds: DataFrame, raw: str = "raw", mode: str = "greedy",
                  keep=("id", "pn_num", "model", "weight")) -> DataFrame:
    """One row per parsed span: ``keep..., span_idx, span``.

    The optimizer puts ``size(parse) > 0`` and ``parse IS NOT NULL`` before an
    inner explode, which parses each output three times; an outer one whose
    empty row is dropped afterwards parses it once.
    """
    spans = preds.select(*keep, F.posexplode_outer(parse_spans(raw, mode)).alias("span_idx", "span"))
    return spans.filter(F.col("span_idx").isNotNull())


def ensemble_locations(pairs: DataFrame, notes: DataFrame, preds: DataFrame, *, threshold: int = 2,
                       n_voters: int | None = None, fuzzy_cutoff: float | None = None,
                       fuzzy_mode: str = "partial", parse_mode: str = "greedy") -> DataFrame:
    """Submission table ``id, location`` (null when no character reaches the threshold).

    ``preds``: ``id, pn_num, model, weight, raw``; ``notes``: ``pn_num, pn_history``
    (one row per note); ``pairs``: ``id`` of every row to submit.
    ``n_voters`` (sum of registry weights) caps the threshold.
    """
    spans = explode_spans(preds, mode=parse_mode)
    located = locate_spans(spans, notes, fuzzy_cutoff=fuzzy_cutoff, fuzzy_mode=fuzzy_mode)
    edged = with_blank_edges(located)
    votes = majority_vote(edged, threshold, n_voters=n_voters)
    loc = format_location(votes)
    return pairs.select("id").join(loc, "id", "left")
