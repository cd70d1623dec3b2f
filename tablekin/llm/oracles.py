"""DuckDB SQL of the operators that SQL can express."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
with items as (select cast(item_id as varchar) as item, {WORDS} as w from benchmark),
item_windows as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as window_text
  from items, unnest(range(1, len(w) - least(len(w), 10) + 2)) as u(p) where len(w) > 0),
docs as (select doc_id, {WORDS} as w from documents),
lengths as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as window_text
  from docs, lengths, unnest(range(1, len(w) - n + 2)) as u(p) where len(w) >= n),
hits as (select d.doc_id, d.n, d.p, i.item from doc_windows d join item_windows i using (n, window_text)),
covered as (
  select doc_id, count(distinct word_at) as n_hit
  from (select doc_id, unnest(range(p, p + n)) as word_at from (select distinct doc_id, n, p from hits)) group by doc_id),
named as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (doc_id) left join named using (doc_id)
"""

CHAT = r"""
with said as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, length(regexp_replace(text,
    '(<|\[|<<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|SYS>>|/SYS>>)', '\1\\\2\3', 'g'))
    + length(role) + 24 as chars from said),
placed as (
  select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as prefix_end,
    sum(chars) over (partition by conv_id) as all_chars,
    max(case when role = 'assistant' then turn end) over (partition by conv_id) as last_reply,
    max(turn) over (partition by conv_id) as last_turn
  from sized)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(coalesce(sum(prefix_end) filter (role = 'assistant'), 0)
    + case when any_value(last_reply) is null or any_value(last_reply) < any_value(last_turn)
      then any_value(all_chars) else 0 end as bigint) as formatted_chars
from placed group by conv_id
"""

REPEATS = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
windows as (
  select doc_id, p, substr(x, 2 * p + 1, 200) as w
  from docs, unnest(range(0, cast(length(x) // 2 - 99 as bigint))) as u(p)),
again as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by w order by doc_id, p) as nth from windows)
  where nth > 1),
stretches as (
  select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as fresh
  from again),
numbered as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from stretches),
runs as (select doc_id, run, min(p) as a, max(p) + 100 as b from numbered group by doc_id, run),
pieces as (
  select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as since,
    row_number() over (partition by doc_id order by a desc) as from_last from runs),
cut as (
  select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last_end,
    string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' order by a) as kept
  from pieces join docs using (doc_id) group by doc_id)
select doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(case when n_spans is null then x else kept || substr(x, 2 * last_end + 1) end)) as kept_sha256
from docs left join cut using (doc_id)
"""

URL_FILTERS = r"""
with rules(rule_host, rule_path, rule_verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests as (
  select page_id, row_number() over () as nth,
    case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
parts as (
  select page_id, nth, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, nth, coalesce(rest, '') as rest from rests)),
fitting as (
  select nth, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by nth)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from parts left join fitting using (nth)
"""

HARD_NEGATIVES = """
with given as (
  select distinct vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
named as (select *, row_number() over (order by vec_id, label, x) as nth from given),
scored as (
  select a.nth as anchor, a.vec_id as anchor_id, c.nth, c.vec_id, a.label = c.label as same,
    cast(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from named a join named c on a.nth <> c.nth where a.vec_id % 100 = 0),
positives as (
  select anchor, anchor_id, vec_id as positive_id, score as positive_score,
    row_number() over (partition by anchor order by score desc, vec_id, nth) as positive_rank
  from scored where same qualify positive_rank <= 5)
select anchor_id, positive_id,
  cast(row_number() over (partition by anchor, positive_rank order by score desc, vec_id, nth) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score, cast(positive_rank as integer) as positive_rank
from positives join scored using (anchor, anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": DECONTAMINATION,
    "op2_suffix_dedup": REPEATS,
    "op8_chat_formatting": CHAT,
    "op12_url_filters": URL_FILTERS,
    "op13_hard_negatives": HARD_NEGATIVES,
}
