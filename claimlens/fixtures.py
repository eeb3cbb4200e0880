"""Small synthetic inputs of the offline check, all of our own making.

Records, a fixed-mask plan and marginals are written as files by `write`, from the rules below and without
Spark, so that the check reads them as a user's inputs and compares two implementations.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from claimlens.functions.identity import ANALYTIC, LIST_FIELDS, NUMBER_FIELDS, STRING_FIELDS
from claimlens.functions.text import POLICY, RATE_LOW, RATE_SPAN, STOPWORDS

VOCABULARY = 7

#: (request, position, target, probabilities): supported claims fit their tokens, refuted ones don't.
MARGINALS = [
    ("delta-supported", 0, 1, [0.04, 0.70, 0.08, 0.06, 0.05, 0.04, 0.03]),
    ("delta-supported", 1, 2, [0.05, 0.05, 0.72, 0.06, 0.05, 0.04, 0.03]),
    ("delta-refuted", 0, 3, [0.04, 0.62, 0.10, 0.09, 0.06, 0.05, 0.04]),
    ("delta-refuted", 1, 4, [0.05, 0.06, 0.66, 0.08, 0.07, 0.05, 0.03]),
    ("ferry-supported", 0, 2, [0.06, 0.05, 0.60, 0.12, 0.07, 0.06, 0.04]),
    ("ferry-refuted", 0, 5, [0.06, 0.05, 0.61, 0.11, 0.08, 0.05, 0.04]),
]

#: (claim, label, pair, scores by mask): the pair says loss, the family says win.
AGGREGATION = [
    ("pair-supported", "supported", "pair-refuted", [1.0, 3.0]),
    ("pair-refuted", "refuted", "pair-supported", [0.5, 0.5]),
    ("extra-supported", "supported", None, [0.0]),
    ("extra-refuted", "refuted", None, [10.0]),
]

FINGERPRINT = {
    "scoring_protocol": "analytic-v1",
    "model_repository": "example/model",
    "model_revision": "1" * 8,
    "tokenizer_revision": "2" * 8,
    "remote_code_revision": "3" * 8,
    "prompt_protocol": "prompt-v1",
    "mask_policy": "fixed-v1",
    "temperature": 1.0,
    "dtype": "float64",
    "inference_backend": "offline",
}

#: (family, sentence, what is true of it, what isn't).
CLAIMS = [
    ("lake", "Lake Vell holds {} islands and no town.", "twelve", "forty"),
    ("mill", "The old mill at Orrin grinds {} in winter.", "barley", "granite"),
    ("road", "A road from Teln to Marsk climbs {} the ridge.", "over", "under"),
    ("clock", "It was the {} clock that they repaired first.", "harbour", "desert"),
]
RECORDS, PLAN, SAVED = "records.jsonl", "fixed-masks.json", "saved-marginals.parquet"
MASK_ID, SEED, TOKENS = 0, 11, 53
EXPECTED = ("ce", "entropy", "collision_probability", "expected_drift")


def fixture_path(name: str, folder: str | Path) -> str:
    """The path of a fixture; FileNotFoundError where the folder lacks it."""
    path = Path(folder, name)
    if not path.is_file():
        raise FileNotFoundError(f"no fixture {name} in {folder}")
    return str(path)


def _record(family: str, text: str, label: str, word: str, other: str) -> dict:
    at, pair = text.index(word), "refuted" if label == "supported" else "supported"
    own, before = {"start": at, "end": at + len(word)}, {"start": at, "end": at + len(other)}
    return {
        "schema_version": "2.0", "example_id": f"{family}-{label}", "family_id": family, "split": "dev", "claim": text, "label": label,
        "domain": "invented places", "fact_type": "entity", "prior_familiarity": "unavailable", "knowledge_audit": None,
        "claim_origin": {"kind": "human", "author": "claimlens"}, "evidence_condition": "none", "evidence_sets": [],
        "atomic_facts": [{"atomic_id": "1", "text": text, "label": label, "claim_span": {"start": 0, "end": len(text)}}],
        "contrast": {"paired_example_id": f"{family}-{pair}", "edit_role": "entity", "original_span": before, "replacement_span": own},
        "annotations": {"annotator_ids": ["one", "two"], "agreement": 1.0, "adjudication_status": "verified", "notes": ""},
        "provenance": {"dataset": "claimlens fixtures", "source_example_id": None, "created_at": "2026-11-26", "license": "CC0-1.0"},
    }


def _request(record: dict) -> dict:
    """A request that masks some words of a record's claim; pieces are runs of four characters of a word."""
    text, example = record["claim"], record["example_id"]
    spans = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)]
    pieces = [[a, min(a + 4, end)] for start, end in spans for a in range(start, end, 4)]
    owner = [i for i, (start, end) in enumerate(spans) for _ in range(start, end, 4)]
    words = [text[a:b].lower() for a, b in spans]
    eligible = [i for i, w in enumerate(words) if w.isalnum() and w not in STOPWORDS]
    base = hashlib.sha256("\0".join((POLICY, str(SEED), example, "prior", "0")).encode()).hexdigest()
    rate = RATE_LOW + RATE_SPAN * (int(base[:16], 16) / 2.0**64)
    drawn = sorted(eligible, key=lambda i: hashlib.sha256(f"{base}\0{i}".encode()).hexdigest())
    chosen = sorted(drawn[: max(1, round(rate * len(eligible)))])
    at = [k for k, word in enumerate(owner) if word in chosen]
    tokens = [1 + zlib.crc32(text[a:b].encode()) % (TOKENS - 1) for a, b in pieces]
    masked = [MASK_ID if k in at else t for k, t in enumerate(tokens)]
    told = {f: FINGERPRINT.get(f, "prior") for f in STRING_FIELDS}
    lists = dict(zip(LIST_FIELDS, (masked, [1] * len(tokens), at, [tokens[k] for k in at]), strict=True))
    payload = told | lists | dict(zip(NUMBER_FIELDS, (rate, 1.0), strict=True))
    work = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return {
        "request_id": f"{example}-0", "example_id": example, "text": text, "arm": "prior", "mask_index": 0, "offsets": pieces,
        "token_ids": tokens, "mask_rate": rate, "word_indices": chosen, "piece_indices": at, "target_ids": lists["target_ids"],
        "masked_input_ids": masked, "work_id": work,
    }


def _marginal(request: dict, place: int, target: int) -> dict:
    """The target of a supported claim has most of the mass, that of a refuted one little; the rest falls off."""
    mass = 0.7 if "supported" in request["example_id"] else 0.04
    shares = [0.0 if i == target else 1.0 / (2 + (i + target + place) % TOKENS) for i in range(TOKENS)]
    p = [mass if i == target else (1 - mass) * x / sum(shares) for i, x in enumerate(shares)]
    entropy, collision = -math.fsum(x * math.log(x) for x in p), math.fsum(x * x for x in p)
    expected = (-math.log(p[target]), entropy, collision, 1 - p[target])
    row = {"request_id": request["request_id"], "position": place, "target_id": target, "probabilities": p}
    return row | {f"expected_{name}": x for name, x in zip(EXPECTED, expected, strict=True)}


def write(folder: str | Path) -> None:
    """Write the records, the plan and the marginals."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    records = [
        _record(family, sentence.format(word), label, word, other)
        for family, sentence, true, false in CLAIMS
        for label, word, other in (("supported", true, false), ("refuted", false, true))
    ]
    requests = [_request(r) for r in records]
    Path(folder, RECORDS).write_text("\n\n".join(map(json.dumps, records)) + "\n", encoding="utf-8")
    plan = {"fixture_kind": "synthetic-correctness-smoke", "mask_token_id": MASK_ID, "requests": requests}
    Path(folder, PLAN).write_text(json.dumps(plan, indent=1), encoding="utf-8")
    rows = [_marginal(r, k, t) for r in requests for k, t in enumerate(r["target_ids"])]
    kind = pa.schema([("request_id", pa.string()), ("position", pa.int32()), ("target_id", pa.int32()), ("probabilities", pa.list_(pa.float64()))])
    for name in EXPECTED:
        kind = kind.append(pa.field(f"expected_{name}", pa.float64()))
    pq.write_table(pa.Table.from_pylist(rows, kind), Path(folder, SAVED))
