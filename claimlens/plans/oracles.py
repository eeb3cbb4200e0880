"""SQL of the registered queries, written from their definitions and not from their plans."""

from __future__ import annotations

from claimlens.functions.text import STOPWORDS
from claimlens.operators.evaluation import RISK, SUMMARY
from claimlens.operators.scoring import REDUCED

_TINY = "2.2250738585072014e-308::double"
_WORD = r"[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)?|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]"
_GAP = r"[_\s\x1c-\x1f\x{85}\p{Z}]+"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _round(columns, decimals: int = 6) -> str:
    return ", ".join(f"round({c}, {decimals}) + 0.0 as {c}" for c in columns)


_LOGITS = """
logits as (select vec_id, list_transform(embedding, lambda x: x::double) as z, label % len(embedding) as t from embeddings),
probs as (select vec_id, t, list_transform(z, lambda x: exp(x - list_max(z))) as w from logits),
p as (select vec_id, t, list_transform(w, lambda x: x / list_sum(w)) as p from probs),
lp as (select vec_id, t, p, list_transform(p, lambda x: ln(greatest(x, {tiny}))) as l from p),
alt as (select *, list_transform(l, lambda x, i: case when i = t + 1 then '-inf'::double else x end) as a from lp),
stats as (select vec_id, t::bigint as target_id, (list_position(p, list_max(p)) - 1)::bigint as top_id,
  (list_position(a, list_max(a)) - 1)::bigint as top_alternative_id,
  -l[t + 1] as ce,
  -list_sum(list_transform(p, lambda x: case when x > 0 then x * ln(greatest(x, {tiny})) else 0 end)) as entropy,
  list_sum(list_transform(p, lambda x: x * x)) as collision_probability,
  list_max(a) - l[t + 1] as swap_llr, 1 - p[t + 1] as expected_drift from alt),
scored as (select *, -ln(collision_probability) as collision_entropy, ce - entropy as delta,
  1 - collision_probability as expected_dispersion, (top_id <> target_id)::int::double as top_mismatch from stats)
""".replace("{tiny}", _TINY)

_STATS = ("ce", "entropy", "collision_probability", "collision_entropy", "delta", "swap_llr", "expected_drift", "expected_dispersion", "top_mismatch")

_CLAIMS = """
masks as (select l_orderkey, l_returnflag, l_linenumber, min(l_quantity) q, min(l_extendedprice) e, min(l_tax) x, min(l_discount) d
  from lineitem group by all),
measured as (select o_orderkey as example_id, l_returnflag as arm, l_linenumber as mask_index, o_custkey as family_id,
  case o_orderstatus when 'F' then 'refuted' when 'O' then 'supported' else 'insufficient' end as label,
  xor(o_orderkey, 1) as pair, e / 10000 as ce_mean, q / 10 as entropy_mean, q / 20 as collision_entropy_mean,
  e / 10000 - q / 10 as delta_mean, x * 10 - d * 10 as swap_llr_mean, q / 50 as expected_drift_mean,
  d * 10 as expected_dispersion_mean, (q > 25)::int::double as top_mismatch_rate
  from masks join orders on l_orderkey = o_orderkey),
raw_claims as (select example_id, arm, family_id, label, pair, count(*) as n_masks, {means} from measured group by all),
claims as (select a.* exclude (pair), case when b.example_id is not null then a.pair end as pair
  from raw_claims a left join raw_claims b on a.pair = b.example_id and a.arm = b.arm),
scores as (select * from (unpivot claims on {risk} into name score value value))
""".replace("{means}", ", ".join(f"avg({c}) as {c}" for c in SUMMARY)).replace("{risk}", ", ".join(RISK))

_AUROC = """
r9 as (select arm, score, label, round(value, 9) as v from scores),
auc as (select p.arm, p.score, sum(case when p.v > n.v then 1.0::double when p.v = n.v then 0.5::double else 0::double end) / count(*) as auroc
  from (select * from r9 where label = 'refuted') p join (select * from r9 where label = 'supported') n
  on p.arm = n.arm and p.score = n.score group by all)
"""
_CONTRAST = """
contrasts as (select r.arm, r.score, r.value - s.value as gap from scores r join scores s
  on r.arm = s.arm and r.score = s.score and r.label = 'refuted' and s.label = 'supported'
  and (r.pair = s.example_id or s.pair = r.example_id)),
contrast as (select arm, score, count(*) as n, count(*) filter (round(gap, 9) > 0) as wins, avg(gap) as mean_gap from contrasts group by all)
"""
_FAMILY = """
families as (select arm, score, family_id, avg(value) filter (label = 'refuted') - avg(value) filter (label = 'supported') as gap
  from scores group by all),
family as (select arm, score, count(*) as n, count(*) filter (round(gap, 9) > 0) as wins, avg(gap) as mean_gap
  from families where gap is not null group by all)
"""


def _gaps(name: str, count: str) -> str:
    return f"""select arm, score, n as {count}, wins, round(wins / n, 6) + 0.0 as win_rate, round(mean_gap, 6) + 0.0 as mean_gap from {name}"""


_WORDS = f"""
tiles as (select item_id, text, regexp_extract_all(text, '{_WORD}|{_GAP}') as t from benchmark),
cut as (select item_id, text, unnest(t) as tile, unnest(range(len(t))) as i from tiles),
placed as (select *, coalesce(sum(length(tile)) over (partition by item_id order by i rows between unbounded preceding and 1 preceding), 0) as s from cut),
words as (select item_id, text, tile as word, s as start_at, s + length(tile) as end_at,
  row_number() over (partition by item_id order by i) - 1 as word_index from placed where not regexp_full_match(tile, '{_GAP}'))
"""
_NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_MASKS = f"""
norm as (select *, {_NORM.format("word")} as n from words),
flagged as (select *, n <> '' as maskable, n <> '' and n not in ({_STOP}) as content from norm),
elig as (select *, content or (maskable and not bool_or(content) over (partition by item_id)) as eligible from flagged),
based as (select item_id, mask_index, sha256('fixed-v1' || chr(0) || '7' || chr(0) || item_id || chr(0) || 'prior' || chr(0) || mask_index) as base
  from (select distinct item_id from words), range(4) r(mask_index)),
rated as (select *, 0.25::double + 0.35::double * (('0x' || substr(base, 1, 16))::ubigint::double / 18446744073709551616::double) as mask_rate from based),
drawn as (select r.item_id, r.mask_index, r.mask_rate, e.word_index,
  row_number() over (partition by r.item_id, r.mask_index order by sha256(r.base || chr(0) || e.word_index), e.word_index) as place,
  count(*) over (partition by r.item_id, r.mask_index) as k from rated r join elig e on r.item_id = e.item_id and e.eligible),
chosen as (select item_id, mask_index, mask_rate, word_index from drawn where place <= greatest(1, least(k, round_even(mask_rate * k, 0)::int))),
plan as (select item_id, mask_index, any_value(mask_rate) as mask_rate, string_agg(word_index, ',' order by word_index) as word_indices from chosen group by all)
"""
_GEOMETRY = """
toks as (select w.item_id, m.mask_index, w.word_index, length(w.word) + 100 as tok, c.word_index is not null as hit, m.mask_rate
  from words w join rated m on w.item_id = m.item_id
  left join chosen c on c.item_id = w.item_id and c.mask_index = m.mask_index and c.word_index = w.word_index),
geo as (select item_id, mask_index, any_value(mask_rate) as mask_rate,
  string_agg(word_index, ',' order by word_index) filter (hit) as piece_indices,
  string_agg(tok, ',' order by word_index) filter (hit) as target_ids,
  string_agg(case when hit then 99 else tok end, ',' order by word_index) as masked_input_ids,
  string_agg(1, ',' order by word_index) as ones from toks group by all)
"""
_WORKS = """
works as (select item_id, mask_index, sha256('{"arm":"prior","attention_mask":[' || ones || '],"dtype":"dtype-v1","inference_backend":"inference_backend-v1","input_ids":['
  || masked_input_ids || '],"mask_policy":"fixed-v1","mask_rate":' || mask_rate || ',"masked_positions":[' || piece_indices
  || '],"model_repository":"model_repository-v1","model_revision":"model_revision-v1","prompt_protocol":"prompt_protocol-v1","remote_code_revision":"remote_code_revision-v1","scoring_protocol":"analytic-v1","target_ids":['
  || target_ids || '],"temperature":1.0,"tokenizer_revision":"tokenizer_revision-v1"}') as work_id from geo)
"""
_RECORDS = """
rec0 as (select o_orderkey as ln, o_orderkey::varchar as id, (o_custkey % 100)::varchar as fam,
  case o_orderstatus when 'F' then 'test' else 'dev' end as split, 'Order ' || o_orderkey as claim, o_orderkey % 3 <> 0 as has,
  case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then o_orderkey when o_orderkey % 7 = 0 then o_orderkey + 2000000
    when o_orderkey % 11 = 0 then o_orderkey + 2 else xor(o_orderkey, 1) end::varchar as pair,
  7 + o_orderkey % 6 as fin from orders),
rec as (from rec0 union all select ln + 10000000, id, '0', split, claim, has, pair, fin from rec0 where ln % 97 = 0)
"""
_CROSS = f"""{_RECORDS},
lastrec as (from rec qualify row_number() over (partition by id order by ln desc) = 1),
j as (select r.*, o.fam as ofam, o.claim as oclaim, o.pair as back, o.id as oid from rec r left join lastrec o on r.pair = o.id where r.has),
v as (select 'X1' as rule, ln, 'duplicate example_id: ' || id as message from rec qualify row_number() over (partition by id order by ln) > 1
  union all select 'X2', null, null from rec group by fam having count(distinct split) > 1
  union all select 'X3', ln, 'paired example is missing' from j where oid is null
  union all select 'X4', ln, 'example is paired with itself' from j where oid = id
  union all select 'X5', ln, 'pair crosses families' from j where oid <> id and ofam <> fam
  union all select 'X6', ln, 'original span is invalid in the paired claim' from j where oid <> id and fin > length(oclaim)
  union all select 'X7', ln, 'pairing is not reciprocal' from j where oid <> id and back is distinct from id
  union all select 'X8', null, null from j group by pair having count(*) > 1)
"""
#: What each damage of a record or a row is told as.
_STRUCTURE = (
    "<row>: missing key domain", "<row>: unknown key extra", "schema_version: not an allowed value", "provenance.created_at: too short",
    "prior_familiarity: not an allowed value", "knowledge_audit.audited_at: not a date-time", "claim_origin.kind: not an allowed value",
    "evidence_condition: not an allowed value", "evidence_sets.0.retrieval_rank: out of range", "atomic_facts.0.claim_span.start: not an integer",
    "contrast.edit_role: not an allowed value", "annotations.agreement: out of range", "invalid JSON: half of a surrogate pair",
    "invalid JSON: nested too deeply", "invalid JSON: integer of too many digits", "knowledge_audit.median_logprob_margin: not a number",
)
_COHERENCE = ("C1", "C3", "C9", "C8 C9", "C7", "C2 C3 C4 C9", "C4 C9", "C5 C8 C9", "C6 C8 C9", "C11", "C11")
_WORK = (
    "", "empty string field", "attention length", "attention length; position out of range", "attention value", "repeated position",
    "position out of range", "target length", "mask rate", "", "analytic temperature", "temperature; analytic temperature", "mask rate",
)
_ALIGNMENT = ("", "word without a piece", "offset outside the claim; piece overlaps two words", "piece overlaps two words", "")
_GEOMETRY_ERRORS = ("none", "word without a piece", "piece of two selected words", "piece outside the tokens", "word out of range", "no piece")
_TAKEN = (
    "C10 cache columns", "C11 result columns", "C12 fingerprint", "C12 temperature 2, other protocol", "C13 environment", "C14 manifest",
    "K4 run", "K6 cache",
)
_REFUSED = (
    "C10 a column more", "C10 a column less", "C10 no rows", "C11 a column less", "C12 empty field", "C12 a field more", "C12 temperature 2",
    "C12 temperature 0", "C13 a field less", "C14 generation 0", "C14 generation true", "C14 a key more", "C14 no shards", "C14 other plan",
    "C14 whole temperature", "C15 name", "C15 row count", "C15 range", "C15 digest", "C15 repeated partition", "K2 not a number",
    "K4 occupied folder", "K4 no run_uuid", "K4 gate without a reason", "K4 repeated rows", "K4 rows less than planned",
    "S6 other format", "S8 unplanned ids",
)


def _numbered(texts, first: int = 0) -> str:
    """A table of (d, told), one row for each text."""
    return "(values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts, first)) + ") as told(d, told)"


_PARTS = "sized as (select (vec_id // 5) % 3 as p, count(distinct vec_id // 5) as n from embeddings group by 1)"


ORACLE_SQL: dict[str, str] = {
    "softmax_probabilities": f"with {_LOGITS} select vec_id, (i - 1)::int as token_id, round(p[i], 9) + 0.0 as probability from p, unnest(range(1, len(p) + 1)) u(i)",
    "marginal_stats": f"with {_LOGITS} select vec_id, target_id, top_id, top_alternative_id, {_round(_STATS)} from scored",
    "reduce_positions": f"""with {_LOGITS}, r as (select vec_id // 5 as request_id, count(*) as n_masked_pieces,
        {", ".join(f"avg({s}) as {n}" for n, s in REDUCED.items())} from scored group by 1) select request_id, n_masked_pieces, {_round(REDUCED)} from r""",
    "statistics_lists": f"""with {_LOGITS} select vec_id // 5 as request_id, string_agg(vec_id % 5, ',' order by vec_id) as masked_positions,
        string_agg(target_id, ',' order by vec_id) as target_ids, string_agg(top_id, ',' order by vec_id) as top_ids,
        string_agg(top_alternative_id, ',' order by vec_id) as top_alternative_ids, count(*)::int as n_masked_pieces,
        round(avg(ce), 6) + 0.0 as ce_mean, round(avg(swap_llr), 6) + 0.0 as swap_llr_mean from scored group by 1""",
    "reduce_claims": f"with {_CLAIMS} select example_id, arm, family_id, label, n_masks, {_round(SUMMARY, 9)} from raw_claims",
    "claim_guards": """with g as (select l_orderkey as example_id, l_returnflag as arm, count(distinct l_suppkey) a, count(distinct l_linestatus) b,
        count(*) n, count(distinct l_linenumber) m from lineitem group by all)
        select example_id, arm, 'inconsistent family_id' as reason from g where a > 1
        union all select example_id, arm, 'inconsistent split' from g where b > 1
        union all select example_id, arm, 'duplicate mask_index' from g where n > m""",
    "claim_auroc": f"with {_CLAIMS}, {_AUROC} select arm, score, round(auroc, 6) + 0.0 as auroc from auc",
    "declared_contrasts": f"with {_CLAIMS}, {_CONTRAST} {_gaps('contrast', 'n_declared_contrasts')}",
    "family_gaps": f"with {_CLAIMS}, {_FAMILY} {_gaps('family', 'n_binary_families')}",
    "arm_metrics": f"""with {_CLAIMS}, {_AUROC}, {_CONTRAST}, {_FAMILY}
        select a.arm, a.score, round(a.auroc, 6) + 0.0 as auroc, coalesce(c.n, 0) as n_declared_contrasts, coalesce(c.wins, 0) as contrast_wins,
        round(c.wins / c.n, 6) + 0.0 as contrast_win_rate, round(c.mean_gap, 6) + 0.0 as contrast_mean_gap,
        coalesce(f.n, 0) as n_binary_families, coalesce(f.wins, 0) as family_wins,
        round(f.wins / f.n, 6) + 0.0 as family_win_rate, round(f.mean_gap, 6) + 0.0 as family_mean_gap
        from auc a left join contrast c using (arm, score) left join family f using (arm, score)""",
    "label_counts": f"""with {_CLAIMS} select arm, count(*) as n_claims, count(distinct family_id) as n_families,
        {", ".join(f"count(*) filter (label = '{x}') as n_{x}" for x in ("supported", "refuted", "insufficient", "ambiguous"))} from claims group by arm""",
    "missing_partners": f"""with {_CLAIMS} select example_id, arm, pair as paired_example_id from raw_claims a
        where not exists (select 1 from raw_claims b where b.example_id = a.pair and b.arm = a.arm)""",
    "word_spans": f"with {_WORDS} select item_id, word_index::int as word_index, word, start_at::int as start_at, end_at::int as end_at from words",
    "content_words": f"""with w as (select doc_id, {_NORM.format("unnest(regexp_extract_all(text, '" + _WORD + "'))")} as w from documents)
        select d.doc_id, count(w) as n_words, count(*) filter (w <> '') as n_maskable, count(*) filter (w <> '' and w not in ({_STOP})) as n_content
        from documents d left join w on w.doc_id = d.doc_id group by d.doc_id""",
    "mask_plan": f"with {_WORDS}, {_MASKS} select item_id, mask_index::int as mask_index, mask_rate, word_indices from plan",
    "word_piece_alignment": f"""with {_WORDS}, pieces as (select item_id, k, 4 * k as a, least(4 * k + 4, length(text)) as b
        from benchmark, unnest(range(((length(text) - 1) // 4 + 1)::bigint)) u(k))
        select w.item_id, w.word_index::int as word_index, string_agg(k, ',' order by k) as pieces from words w join pieces p
        on w.item_id = p.item_id and p.b > w.start_at and p.a < w.end_at group by w.item_id, w.word_index""",
    "mask_geometry": f"with {_WORDS}, {_MASKS}, {_GEOMETRY} select item_id, mask_index::int as mask_index, piece_indices, target_ids, masked_input_ids from geo",
    "work_ids": f"with {_WORDS}, {_MASKS}, {_GEOMETRY}, {_WORKS} select item_id, mask_index::int as mask_index, work_id from works",
    "id_digests": f"""with {_WORDS}, {_MASKS}, {_GEOMETRY}, {_WORKS} select item_id % 5 as partition_index, count(*) as row_count,
        min(work_id) as first_work_id, max(work_id) as last_work_id, sha256(string_agg(work_id, chr(10) order by work_id) || chr(10)) as work_ids_sha256,
        sha256(string_agg(work_id, chr(10) order by work_id)) as plan_hash from works group by 1""",
    "plan_diff": """with r as (select distinct l_orderkey as k from lineitem where l_linenumber = 1), p as (select o_orderkey as k from orders where o_orderstatus <> 'P')
        select k as work_id, 'missing' as side from (from p except from r) union all select k, 'unexpected' from (from r except from p)""",
    "cache_misses": "select o_orderkey as work_id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 10)",
    "overlapping_shards": """select distinct a.l_suppkey % 50 as partition_index from lineitem a join lineitem b
        on a.l_orderkey = b.l_orderkey and b.l_suppkey % 50 < a.l_suppkey % 50""",
    "cross_row_violations": f"with {_CROSS} select rule, count(*) as n, sum(ln)::bigint as lines from v group by rule",
    "violation_preview": f"""with {_CROSS}, r as (select ln, rule, message, row_number() over (order by ln, rule, message) as place from v where ln is not null)
        select place - 1 as place, '- line ' || ln || ' ' || rule || ': ' || message as shown from r where place <= 20
        union all select 20, '- ... and ' || (count(*) - 20) || ' more' from r having count(*) > 20""",
    "semantic_violations": f"""with {_RECORDS}, e as (select *, case when ln % 6 = 0 then 0 when ln % 9 = 0 then 2 else 1 end as ne, ln % 4 = 0 as bare,
          case when ln % 5 < 2 then 'none' when ln % 5 = 2 then 'gold' else 'retrieved' end as cond,
          case when ln % 3 = 0 then 'recall' when ln % 3 = 1 then 'recognition' else 'weak' end as st, ln % 8 <> 0 as audit from rec),
        v as (select 'R1' as rule, ln from e where not (0 < ln % 12 and ln % 12 <= length(claim))
          union all select 'R2', ln from e where cond = 'none' and ne > 0
          union all select 'R3', ln from e where cond <> 'none' and ne = 0
          union all select 'R4', ln from e where ne = 2
          union all select 'R5', ln from e where ne > 0 and not bare and not (1 < ln % 15 and ln % 15 <= 12)
          union all select 'R6', ln from e where cond = 'gold' and ne > 0 and bare
          union all select 'R7', ln from e where ln % 17 = 0
          union all select 'R8', ln from e where split = 'test' and ln % 2 <> 0
          union all select 'R9', ln from e where has and fin > length(claim)
          union all select 'R10', ln from e where audit and (ln % 4 < 2) <> (st <> 'weak')
          union all select 'R11', ln from e where audit and (ln % 5 = 0) <> (st = 'recall')
          union all select 'R12', ln from e where audit and ln % 13 = 0)
        select rule, count(*) as n, sum(ln)::bigint as lines from v group by rule""",
    "physical_coherence": f"""with r as (select distinct vec_id // 5 as q from embeddings)
        select unnest(string_split(told, ' ')) as rule, count(*) as n from r join {_numbered(_COHERENCE, 1)} on q % 25 = d group by rule""",
    "evidence_by_arm": """with t as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) as t from conversations group by 1)
        select conv_id, 'prior' as arm, sha256('') as evidence_sha256 from t union all select conv_id, 'supplied_evidence', sha256(t) from t""",
    "record_structure": f"""select coalesce(told, 'none') as violation, count(*) as n, sum(o_orderkey)::bigint as lines
        from orders left join {_numbered(_STRUCTURE, 1)} on o_orderkey % 23 = d group by 1""",
    "scoring_view": f"""select 'e' || o_orderkey as example_id, 'f' || o_orderkey as family_id, 'dev' as split, 'Order ' || o_orderkey || ' is late.' as claim,
        'refuted' as label, 'trade' as domain, 'date' as fact_type, 'unknown' as prior_familiarity, 'retrieved' as evidence_condition,
        'Evidence ' || o_orderkey || '.' as evidence_texts, 'p' || o_orderkey as paired_example_id, 'weak' as knowledge_status, false as knowledge_passed
        from orders where o_orderkey % 23 not between 1 and {len(_STRUCTURE)}""",
    "numbered_lines": """select (row_number() over w + coalesce(sum((n_nationkey % 3 = 0)::int) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as line_number,
        n_name as raw from nation window w as (order by n_nationkey)""",
    "plan_requests": f"""with {_WORDS}, {_MASKS} select item_id || '-' || mask_index as request_id, item_id::bigint as item_id, mask_index::int as mask_index,
        word_indices, 99 as mask_token_id from plan""",
    "attach_examples": """select o_orderkey as request_id, case when o_orderkey % 7 <> 0 then o_custkey::varchar end as family_id,
        case when o_orderkey % 7 <> 0 then case o_orderstatus when 'F' then 'refuted' when 'O' then 'supported' else 'insufficient' end end as label,
        o_orderkey % 7 = 0 or o_orderkey % 5 = 0 as mismatch from orders""",
    "attach_marginals": """select (vec_id // 5)::varchar as request_id, (vec_id % 5)::int as position, (label % len(embedding))::int as target_id,
        vec_id % 7 <> 0 as found, vec_id % 7 = 0 or vec_id % 11 = 0 as mismatch from embeddings""",
    "invalid_distributions": "select vec_id, vec_id % 10 in (0, 6, 8, 9) as valid, vec_id % 10 in (0, 6) as scored from embeddings",
    "work_errors": f"select told as reasons, count(*) as n, sum(vec_id)::bigint as ids from embeddings join {_numbered(_WORK)} on vec_id % 13 = d group by told",
    "alignment_errors": f"select item_id, told as errors from benchmark join {_numbered(_ALIGNMENT)} on item_id % 5 = d",
    "geometry_errors": f"select item_id, told as error from benchmark join {_numbered(_GEOMETRY_ERRORS)} on item_id % 6 = d",
    "run_counts": f"""with {_CLAIMS} select count(*) as n_mask_rows, count(distinct example_id) as n_examples, count(distinct family_id) as n_families,
        count(distinct (example_id, mask_index)) as n_work_ids from measured""",
    "evaluation_document": f"""with {_CLAIMS}, {_AUROC}, {_CONTRAST}, {_FAMILY},
        sizes as (select arm, count(*) as n_claims, count(distinct family_id) as n_families from claims group by arm)
        select arm, a.score, round(a.auroc, 6) + 0.0 as auroc, coalesce(c.n, 0) as n_declared_contrasts, round(c.mean_gap, 6) + 0.0 as contrast_mean_gap,
        coalesce(f.n, 0) as n_binary_families, round(f.mean_gap, 6) + 0.0 as family_mean_gap, n_claims, n_families, (select count(*) from measured) as n_mask_rows
        from auc a left join contrast c using (arm, score) left join family f using (arm, score) join sizes using (arm)""",
    "cache_lifecycle": f"""with {_PARTS} select step, p::int as partition_index, generation, state, case when state in ('refused', 'failed') then 0 else n end as n_rows
        from sized join (values ('published', 3, 0, 'sealed'), ('published', 3, 1, 'sealed'), ('published', 3, 2, 'sealed'),
          ('repeated', 3, 0, 'sealed'), ('repeated', 3, 1, 'sealed'), ('repeated', 3, 2, 'sealed'), ('replaced', 3, 1, 'refused'),
          ('damaged', 3, 0, 'valid'), ('damaged', 3, 1, 'valid'), ('damaged', 3, 2, 'failed'), ('unrepaired', 3, 0, 'refused'), ('unrepaired', 3, 2, 'refused'),
          ('repaired', 4, 0, 'sealed'), ('repaired', 4, 1, 'sealed'), ('repaired', 4, 2, 'sealed'),
          ('hydrated', 4, 0, 'read'), ('hydrated', 4, 1, 'read'), ('hydrated', 4, 2, 'read')) as s(step, generation, q, state) on p = q""",
    "sealed_bundle": f"""with {_LOGITS} select sha256((vec_id // 5)::varchar) as work_id, 'request-' || (vec_id // 5) as example_id, count(*)::int as n_masked_pieces,
        round(avg(ce), 6) + 0.0 as ce_mean, round(avg(entropy), 6) + 0.0 as entropy_mean, string_agg(target_id, ',' order by vec_id) as target_ids,
        (select count(distinct vec_id // 5) from embeddings) as n_rows, true as whole from scored group by vec_id // 5""",
    "protocol_checks": f"""select told as case, true as accepted from {_numbered(_TAKEN)} union all select told, false from {_numbered(_REFUSED)}""".replace("as case", 'as "case"'),
    "canonical_rows": r"""select p_partkey, sha256('{"Price":' || p_retailprice::double || ',"nested":{"a":' || (p_partkey % 4 = 0) || ',"m":[' || p_partkey || ',' || p_partkey % 4
        || '],"z":' || case p_partkey % 4 when 1 then '"q\"uote\\"' when 2 then '"tab\tbell\u0007 é"' when 3 then 'null' else '"' || p_name || '"' end
        || '},"share":' || (p_partkey % 4) / 4 || '}') as row_sha256 from part""",
    "offline_check": """select * from (values (0, 'aggregation: masks, pairs and families are reduced apart'), (1, 'records: 8 records of 4 families are valid'),
        (2, 'plan: alignment, masks, geometry and work ids follow from the claims, in any order'),
        (3, 'scoring: saved statistics agree, and refuted claims score above supported ones'),
        (4, 'bundle: 8 results and their receipt are sealed'), (5, 'cache: a damaged shard is isolated and repaired')) as t(place, passed)""",
    "tolerance_checks": "select (p_partkey % 7) * 3e-11 <= 1e-10 as agrees, count(*) as n from part group by 1",
}
