"""All queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from rillframe.llm import queries

QUERIES = {name: getattr(queries, name) for name in ("p1_found", "p4_runs", "p4_found", "p7_leaks", "p7_found", "p8_mix", "p8_shares", "p8_letters", "p8_letter_shares", "p9_found")}

P1_SQL = """
with f as (select distinct recording_id, frame, cam_reset_perf_counter_us + t_left_us as h, imu_stream_id from sync_log join recordings using (recording_id) where t_left_us is not null),
l as (select distinct recording_id as src, sample, host_time_us as h from imu_log where host_time_us is not null),
s as (select distinct stream_id as src, sample, floor(host_time_s * 1e6)::bigint as h from imu_sample where host_time_s is not null),
m as (select recording_id, frame, 'imu_log' as imu_table, sample, abs(l.h - f.h) as d, l.h as rh from f join l on l.src = f.recording_id and l.h between f.h - 10000 and f.h + 10000
 union all select recording_id, frame, 'imu_sample', sample, abs(s.h - f.h), s.h from f join s on s.src = f.imu_stream_id and s.h between f.h - 10000 and f.h + 10000)
select recording_id, frame, imu_table, sample from (select *, row_number() over (partition by recording_id, frame order by d, rh, sample) as n from m) where n = 1"""

# Phrases are told by the least number of slips, with and without the words around them, if that leaves one command.
_RUNS = r"""
with t as (select distinct recording_id, trigger_id, phrase, start_us, end_us from triggers where phrase is not null),
p as (select distinct phrase, regexp_replace(nfc_normalize(lower(phrase)), '[^\p{L}\p{M}\p{N}]+', '', 'g') as raw from t),
q as (select phrase, raw, regexp_replace(regexp_replace(raw, '^(okay|ok|uh|um|and|so|well|please|now|hey|äh|ähm|und|bitte|jetzt|also|eh|vale|porfavor|ya|y|ahora|那么|嗯|请|好|えっと|はい|では|ください)+', ''), '(okay|ok|uh|um|and|so|well|please|now|hey|äh|ähm|und|bitte|jetzt|also|eh|vale|porfavor|ya|y|ahora|那么|嗯|请|好|えっと|はい|では|ください)+$', '') as bare from p),
c as (select command_id, regexp_replace(nfc_normalize(lower(phrase)), '[^\p{L}\p{M}\p{N}]+', '', 'g') as known from commands),
n as (select phrase, command_id, least(damerau_levenshtein(strip_accents(raw), strip_accents(known)), damerau_levenshtein(strip_accents(bare), strip_accents(known))) as slips from q, c),
l as (select phrase, command_id, slips, min(slips) over (partition by phrase) as least from n where slips <= 1),
k as (select phrase, min(command_id) as command_id from l where slips = least group by phrase, least having least = 0 or count(*) = 1),
m as (select t.*, coalesce(k.command_id::varchar, '?' || t.phrase) as meaning from t left join k using (phrase)),
a as (select *, case when meaning = lag(meaning) over w then 0 else 1 end as new from m window w as (partition by recording_id order by start_us, trigger_id)),
b as (select *, sum(new) over (partition by recording_id order by start_us, trigger_id rows unbounded preceding) as island from a),
e as (select *, max(end_us) over (partition by recording_id, island order by start_us, trigger_id rows between unbounded preceding and 1 preceding) as reach from b),
g as (select *, sum(case when start_us - reach < 1000000 then 0 else 1 end) over (partition by recording_id order by start_us, trigger_id rows unbounded preceding) as run from e)"""

P4_SQL = f"""{_RUNS}
select recording_id, arg_min(trigger_id, (start_us, trigger_id)) as first_trigger_id, count(*) as n_triggers, max(end_us) - min(start_us) as duration_us
from g where meaning not like '?%' group by recording_id, run having count(*) >= 2"""

P4_RUNS_SQL = f"""{_RUNS}
select recording_id, arg_min(trigger_id, (start_us, trigger_id)) as first_event, any_value(meaning) as label, count(*) as n, min(start_us) as start, max(end_us) as "end", max(end_us) - min(start_us) as duration
from g group by recording_id, run"""

# Sizes are summed in the order of the hash: a record is in as long as the sum up to it stays within the budget.
_MIX = r"""
with g as (select nullif(regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g'), '') as source, sum(target_share) as share, max(max_repeats) as cap from mix_targets where target_share > 0 and max_repeats > 0 group by 1 having source is not null),
d as (select doc_id, nullif(regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g'), '') as source, n_chars as size from documents where doc_id is not null and n_chars > 0),
r as (select doc_id, arg_max(source, (size, source)) as source, arg_max(size, (size, source)) as size from d where source in (select source from g) group by doc_id),
h as (select *, ('0x' || substr(md5('0:' || doc_id::varchar), 1, 15))::bigint as h from r),
s as (select source, sum(size)::bigint as have from h group by source),
p as (select source, share, cap, have, share / (sum(share) over ()) as part from s join g using (source)),
b as (select *, least(floor(floor((min(cap * have / part) over ()) + 1e-6) * part + 1e-6)::bigint, cap * have) as budget from p),
w as (select *, budget // have as whole, budget - (budget // have) * have as rest from b),
c as (select h.*, w.whole, w.rest, sum(size) over (partition by source order by h) as upto from h join w using (source)),
m as (select doc_id, source, size, (whole + case when upto <= rest then 1 else 0 end)::int as repeats from c)"""

P8_SQL = f"{_MIX} select doc_id, source, size, repeats from m where repeats > 0"

P8_SHARES_SQL = f"""{_MIX},
u as (select source, sum(size * repeats)::bigint as used, max(repeats) as most from m where repeats > 0 group by source)
select source, share as target_share, cap as max_repeats, coalesce(have, 0) as available, coalesce(budget, 0) as budget, coalesce(used, 0) as used, coalesce(most, 0) as most_repeats,
 coalesce(used, 0)::double / (select sum(used) from u) as actual_share
from (select source, g.share, g.cap, have, budget from g left join w using (source)) left join u using (source)"""

ORACLES: dict[str, str] = {"p1_found": P1_SQL, "p4_runs": P4_RUNS_SQL, "p4_found": P4_SQL, "p8_letters": P8_SQL, "p8_letter_shares": P8_SHARES_SQL}
