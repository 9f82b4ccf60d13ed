"""The registered queries as plain SQL for DuckDB, written from the tables alone."""

from __future__ import annotations

import re


def _time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || '0Z'"


# Named sub-queries; each may use those above it.
VIEWS = {
    "v_archives": """
        select 'arc-' || c_custkey as archive_id,
               case c_mktsegment when 'MACHINERY' then 'Journal' when 'FURNITURE' then 'Fsa'
                    else 'Mailbox' end as type,
               case when c_mktsegment not in ('MACHINERY', 'FURNITURE') and c_acctbal >= 0
                    then c_name || '@Contoso.com' end as owner_upn,
               c_custkey % 10 = 0 as legal_hold,
               'VS-' || n_name as vault_store
        from customer join nation on c_nationkey = n_nationkey""",
    "v_map": """
        select lower(c_name) || '@contoso.com' as upn, 'tgt-' || c_custkey as target_archive
        from customer
        where c_mktsegment not in ('MACHINERY', 'FURNITURE') and c_custkey % 7 <> 0""",
    "v_items": """
        select 'itm-' || o_orderkey as item_id, 'arc-' || o_custkey as archive_id,
               case substr(o_orderpriority, 1, 1) when '1' then 'Inbox' when '2' then 'INBOX/Projects'
                    when '3' then 'Sent Items' when '4' then 'Inbox/Legal' when '5' then 'Archive'
               end as folder_path,
               'Order ' || o_orderkey as subject, o_orderdate as sent_date_utc,
               'user' || o_custkey || '@contoso.com' as sender,
               'team' || (o_orderkey % 50) || '@contoso.com' as team,
               o_orderkey % 3 = 0 as has_cc, o_orderkey % 11 = 0 as has_bcc,
               case substr(o_orderpriority, 1, 1) when '1' then 'Legal-7Y' when '2' then 'Finance-10y'
                    when '3' then 'Standard-3Y' when '4' then 'NoExpiry' when '5' then 'Archive-1Y'
               end as retention_category,
               cast(floor(o_totalprice) as bigint) as size_bytes,
               case o_orderstatus when 'F' then 'IPM.Note' when 'O' then 'IPM.Appointment'
                    else 'IPM.Post' end as message_class
        from orders""",
    "v_refs": """
        select 'itm-' || l_orderkey as item_id, 'prt-' || l_partkey as part_id,
               row_number() over (partition by l_orderkey
                   order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as pos
        from lineitem""",
    "v_blobs": """
        select 'prt-' || p_partkey as part_id, p_name || '|' || p_brand as payload
        from part where p_partkey % 97 <> 0""",
    "v_parts": """
        select 'prt-' || p_partkey as part_id, strlen(p_name || '|' || p_brand) as size_bytes,
               case when p_partkey % 50 = 0 then repeat('0', 64)
                    else upper(sha256(p_name || '|' || p_brand)) end as sha256
        from part where p_partkey % 89 <> 0""",
    "v_verified": """
        select coalesce(p.part_id, b.part_id) as part_id, sha256(b.payload) as sha256, p.size_bytes,
               case when b.part_id is null then 'BLOB_NOT_FOUND'
                    when p.part_id is null then 'PART_NOT_FOUND'
                    when lower(p.sha256) <> sha256(b.payload) then 'HASH_MISMATCH' end as error
        from v_parts p full join v_blobs b on p.part_id = b.part_id""",
    "v_checked": """
        select r.item_id, r.pos, r.part_id, v.sha256, v.size_bytes,
               case when v.part_id is null then 'BLOB_NOT_FOUND' else v.error end as error
        from v_refs r left join v_verified v on r.part_id = v.part_id""",
    "v_bad": """
        select item_id, error, part_id, pos from (
            select *, row_number() over (partition by item_id order by pos) as rn
            from v_checked where error is not null) where rn = 1""",
    "v_content": """
        select i.item_id, count(c.part_id) as n_parts,
               cast(coalesce(sum(c.size_bytes), 0) as bigint) as bytes,
               max(b.error) as error_code, max(b.part_id) as error_part
        from v_items i left join v_checked c on i.item_id = c.item_id
             left join v_bad b on i.item_id = b.item_id
        group by i.item_id""",
    "v_routes": """
        select a.*,
               case when a.type = 'Journal' then 'compliance_journal:' || archive_id
                    when a.type = 'Fsa' then 'file_archive:' || archive_id
                    else m.target_archive end as target_archive,
               case when a.type = 'Mailbox' and owner_upn is null then 'NullOwnerUpn'
                    when a.type = 'Mailbox' and m.upn is null then 'Unmapped' end as orphan_reason
        from v_archives a left join v_map m on lower(a.owner_upn) = m.upn""",
    "v_scanned": """
        select i.*, r.type, r.vault_store, r.legal_hold, r.target_archive,
               'ev:' || r.vault_store || ':' || i.archive_id || ':' || i.item_id as key
        from v_items i join v_routes r on i.archive_id = r.archive_id
        where not r.legal_hold and r.orphan_reason is null""",
    "v_run_items": """
        select s.*, c.n_parts, c.bytes, c.error_code, c.error_part
        from v_scanned s join v_content c on s.item_id = c.item_id""",
    "v_item_events": """
        select 'evt-' || event_id as id, ts as timestamp_utc,
               case event_type when 'purchase' then 'ItemMigrated' when 'signup' then 'ItemAlreadyPresent'
                    when 'view' then 'ItemSkipped' when 'click' then 'ItemTransientFailed'
                    when 'error' then 'ItemPermanentFailed' end as event_type,
               'itm-' || event_id as item_id, 'arc-' || user_id as archive_id,
               case when event_type in ('click', 'error')
                    then 'E' || regexp_extract(props, '([0-9]+)', 1) end as error_code,
               case when event_type in ('click', 'error')
                    then '{"archiveId":"arc-' || user_id || '","errorCode":"E'
                         || regexp_extract(props, '([0-9]+)', 1) || '"}'
                    else '{"archiveId":"arc-' || user_id || '"}' end as payload,
               'run-' || (user_id % 5) as run_id
        from events""",
    "v_run_totals": """
        select run_id, min(timestamp_utc) as first, max(timestamp_utc) as last, count(*) as total_items,
               count(*) filter (event_type = 'ItemMigrated') as migrated,
               count(*) filter (event_type = 'ItemAlreadyPresent') as already_present,
               count(*) filter (event_type = 'ItemSkipped') as skipped,
               count(*) filter (event_type in ('ItemTransientFailed', 'ItemPermanentFailed')) as failed
        from v_item_events group by run_id""",
    "v_audit": """
        select id, timestamp_utc, event_type, item_id, archive_id, error_code, payload, run_id
        from v_item_events
        union all
        select 'start-' || run_id, first, 'RunStarted', null, null, null,
               '{"runId":"' || run_id || '","dryRun":false}', run_id from v_run_totals
        union all
        select 'end-' || run_id, last,
               case when run_id = 'run-3' then 'RunFailed' else 'RunCompleted' end, null, null, null,
               case when run_id = 'run-3' then '{}' else
               '{"totalItems":' || total_items || ',"migrated":' || migrated || ',"alreadyPresent":'
               || already_present || ',"orphaned":0,"skipped":' || skipped || ',"failed":' || failed || '}'
               end, run_id
        from v_run_totals where run_id <> 'run-4'""",
    "v_runs": """
        select run_id, first as started_at_utc,
               case run_id when 'run-3' then 'Failed' when 'run-4' then 'Running' else 'Completed' end as status
        from v_run_totals""",
    "v_attempts": """
        select 'key-' || num as key, event_id, ts, k,
               case when k < 60 then 200 when k < 75 then 503 when k < 85 then 429 when k < 93 then 422
               end as http_status,
               case when k < 93 then null when k < 97 then 'HttpRequestException'
                    else 'TaskCanceledException' end as exception,
               case when k < 60 then 'sx-' || num end as target_id,
               case when k between 75 and 84 then cast(k % 5 + 1 as double) end as retry_after,
               case when k < 60 and k % 10 = 0 then 'AlreadyPresent' when k < 60 then 'Ingested'
                    when k between 85 and 92 then 'PermanentError' else 'TransientError' end as ingest_status,
               case when k < 60 then null when k < 75 then 'ServiceUnavailable'
                    when k < 85 then 'TooManyRequests' when k < 93 then 'UnprocessableEntity'
                    when k < 97 then 'HttpRequestException' else 'TaskCanceledException' end as error_code
        from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
                     case when event_id // 20 % 4 = 0 then 'long-' || (event_id // 20)
                          else cast(event_id // 5 as varchar) end as num
              from events)""",
    "v_receipts": """
        select 'itm-' || (event_id // 2) as item_id, arg_max(k, event_id) as k,
               arg_max(ts, event_id) as ts, count(*) as attempts
        from v_attempts group by 1""",
    "v_answers": """
        select i.*, r.k, r.ts, r.attempts, i.error_code is null and r.k < 60 as good,
               i.error_code is not null or r.k >= 60 as bad
        from v_run_items i left join v_receipts r on i.item_id = r.item_id""",
    "v_rollup": """
        select *, http_status in (503, 429) or coalesce(exception = 'HttpRequestException', false) as retryable_raw
        from (select *, row_number() over (partition by key order by ts desc, event_id desc) as rn,
                     count(*) over (partition by key) as attempts
              from v_attempts) where rn = 1""",
    "v_log": """
        select 'ev:VS-1:arc-' || (event_id // 120) || ':itm-' || (event_id // 3) as key,
               'itm-' || (event_id // 3) as item_id, 'arc-' || (event_id // 120) as archive_id,
               'tgt-' || (event_id % 7) as target_archive, ts, event_id,
               event_type = 'purchase' as good,
               case when event_type = 'purchase' then 'sx-' || event_id end as target_id,
               'E' || regexp_extract(props, '([0-9]+)', 1) as code
        from events where event_type in ('purchase', 'error')""",
    "v_folded": """
        select key, arg_min(item_id, (ts, event_id)) as source_item_id,
               arg_min(archive_id, (ts, event_id)) as archive_id,
               arg_min(target_archive, (ts, event_id)) as target_archive,
               arg_max(target_id, (ts, event_id)) filter (good) as target_id,
               case when bool_or(good) then 'Migrated' else 'Failed' end as status,
               min(ts) as extracted, max(ts) filter (good) as ingested, max(ts) as attempted,
               count(*) as attempt_count,
               case when not bool_or(good) then arg_max(code, (ts, event_id)) end as code
        from v_log group by key""",
    "v_checkpoints": """
        select 'run-' || (user_id % 5) as run_id,
               case event_type when 'view' then 'ArchiveScan' when 'click' then 'ItemExtract'
                    else 'Ingest' end as phase,
               ts, '{"processedCount":' || event_id || '}' as metadata
        from events""",
    "v_history": """
        select 'key-' || user_id as key, event_id, ts,
               case event_type when 'signup' then 'Discovered' when 'view' then 'Mapped'
                    when 'click' then 'Rehydrated' when 'purchase' then 'Ingesting'
                    when 'error' then 'Failed' end as status
        from events""",
    "v_docs": """
        select doc_id, 'ev:docs:all:' || doc_id as key, source, sha256(text) as sha,
               strlen(text) as bytes,
               row_number() over (partition by sha256(text) order by doc_id) as rn
        from documents""",
    "v_seqs": """
        select 'ev:VS-1:itm-' || o_orderkey as key, o_orderkey as seq, o_orderkey as order_key from orders
        union all
        select 'ev:VS-1:itm-' || o_orderkey, o_orderkey + 1000000000000, o_orderkey
        from orders where o_orderkey % 3 = 0""",
    "v_uses": """
        select *, row_number() over (partition by sha order by l_orderkey, l_linenumber, l_partkey,
                      l_suppkey, l_quantity, l_extendedprice) as rn,
               sha in (select sha256('part ' || (p_partkey // 4)) from part where p_partkey % 40 = 0) as stored
        from (select *, sha256('part ' || (l_partkey // 4)) as sha from lineitem
              where l_orderkey % 5 <> 0)""",
    "v_use_totals": """
        select l_orderkey, count(*) as n_parts, cast(sum(l_quantity) as bigint) as bytes,
               bool_or(rn > 1 or stored) as deduped
        from v_uses group by l_orderkey""",
    "v_mine": """
        select 'ev:VS-1:itm-' || o_orderkey as key, 'tgt-' || o_custkey as archive,
               o_custkey % 10 = 0 as hold from orders where o_orderkey % 4 <> 0""",
    "v_theirs": """
        select 'ev:VS-1:itm-' || o_orderkey as key,
               case when o_orderkey % 9 = 0 then 'tgt-moved' else 'tgt-' || o_custkey end as archive,
               (o_custkey % 10 = 0) <> (o_orderkey % 13 = 0) as hold
        from orders where o_orderkey % 5 <> 0""",
    "v_list_diff": """
        select distinct 'ev:VS-1:itm-' || conv_id as key from conversations
        where (conv_id * 7 + turn) % 19 = 0
           or ((conv_id + turn) % 17 = 0 and sha256(role) <> sha256(text))""",
    "v_compare": """
        select coalesce(m.key, t.key) as key, m.key is not null as ours, t.key is not null as there,
               m.archive is distinct from t.archive as d_archive, m.hold is distinct from t.hold as d_hold,
               p.key is not null as d_parts
        from v_mine m full join v_theirs t on m.key = t.key
             left join v_list_diff p on p.key = coalesce(m.key, t.key)""",
    "v_lines": "select *, l_orderkey || '-' || l_linenumber as row_key from lineitem",
    "v_broken": """
        select row_key, 'required:source_item_id' as rule from v_lines where l_partkey % 100 = 0
        union all select row_key, 'max_length:archive_id' from v_lines where l_suppkey % 50 = 0
        union all select row_key, 'domain:status' from v_lines where l_linestatus <> 'F'
        union all select row_key, 'unique:idempotency_key' from v_lines
                  group by row_key having count(*) > 1""",
    "v_foreign": """
        select case when o_orderkey % 10 = 0 then 'ev:only-two-' || o_orderkey
                    when o_orderkey % 10 = 1 then 'ev:VS:arc:itm:' || o_orderpriority || ':x'
                    when o_orderkey % 10 = 2 then '   '
                    else 'ev:VS:arc-' || o_custkey || ':itm-' || o_orderkey end as key_text
        from orders
        union all select url from pages
        union all select source from documents""",
    "v_parsed": r"""
        select *, regexp_full_match(key_text, '(?s)ev:[^:]*:[^:]*:.*') as valid from v_foreign""",
}

_FILTERED = """
        case when sent_date_utc < timestamp '1994-01-01' then 'Item predates FromUtc filter.'
             when sent_date_utc >= timestamp '2000-01-01' then 'Item is at or after ToUtc filter.'
             when not starts_with(lower(folder_path), 'inbox') then 'FolderPath filter not matched.'
             when lower(retention_category) <> 'legal-7y' then 'RetentionCategory filter not matched.'
        end"""


def _decided(skip: str = "cast(null as varchar)", retain: bool = True) -> str:
    hold = (
        "when legal_hold then 'LegalHoldRetain|Archive is under legal hold; policy is Retain.'"
        if retain
        else ""
    )
    after = (
        ""
        if retain
        else "when legal_hold then 'LegalHoldMigrate|Archive is under legal hold; policy is Migrate.'"
    )
    return f"""
        select *, split_part(decision, '|', 1) as outcome, split_part(decision, '|', 2) as reason
        from (select *, case when skip is not null then 'SkippedByFilter|' || skip {hold}
                     when type = 'Mailbox' and owner_upn is null
                     then 'Orphaned|Mailbox archive has no owner UPN.' {after}
                     else 'Proceed|No exclusion rules matched.' end as decision
              from (select *, {skip} as skip from v_items join v_archives using (archive_id)))"""


def _outcomes(decided: str) -> str:
    return f"select type, outcome, reason, count(*) as items from ({decided}) group by all"


_TOTALS = """
    (select count(*) from v_archives) as total_archives, count(*) as total_items"""
_ORPHANS = "(select count(*) from v_routes where not legal_hold and orphan_reason is not null)"
_ZERO = "cast(0 as bigint)"
_AS_OF = "'2024-06-01 00:00:00.000000'"


def _run_totals(run_id: str, second: bool = False) -> str:
    good = "count(*) filter (good)"
    return f"""
        select '{run_id}' as run_id, {_AS_OF} as started_at_utc, {_AS_OF} as finished_at_utc, {_TOTALS},
               {_ZERO if second else good} as migrated, {good if second else _ZERO} as already_present,
               {_ORPHANS} as orphaned, {_ZERO} as skipped, count(*) filter (bad) as failed
        from v_answers"""


_INBOX = "lower(folder_path) like 'inbox%'"
_ARCHIVE_COUNTS = """
    count(*) filter (event_type in ('ItemMigrated', 'ItemDryRun')) as migrated,
    count(*) filter (event_type = 'ItemAlreadyPresent') as already_present,
    count(*) filter (event_type = 'ItemSkipped') as skipped,
    count(*) filter (event_type in ('ItemPermanentFailed', 'ItemTransientFailed',
                                    'ItemUnexpectedError')) as failed"""
_SUMMARY = f"""
    select t.run_id, {_time('t.first')} as started_at_utc,
           case when r.status = 'Completed' then {_time('t.last')} end as finished_at_utc,
           case when r.status = 'Completed' then {_ZERO} else {{none}} end as total_archives,
           case when r.status = 'Completed' then total_items else {{none}} end as total_items,
           case when r.status = 'Completed' then migrated else {{none}} end as migrated,
           case when r.status = 'Completed' then already_present else {{none}} end as already_present,
           case when r.status = 'Completed' then {_ZERO} else {{none}} end as orphaned,
           case when r.status = 'Completed' then skipped else {{none}} end as skipped,
           case when r.status = 'Completed' then failed else {{none}} end as failed {{more}}
    from v_run_totals t join v_runs r on t.run_id = r.run_id"""
_HISTOGRAM = """
    select run_id, date_trunc('minute', timestamp_utc) as m, count(*) as ingested
    from v_item_events where event_type = 'ItemMigrated' group by all"""
_RATIO = f"""
    select {_time('w')} as window_start, count(*) as deliveries, count(*) filter (bad) as failures,
           round(count(*) filter (bad) / count(*), 6) as failure_ratio,
           count(*) filter (bad) / count(*) >= 0.5 as tripped
    from (select time_bucket(interval 30 seconds, ts) as w,
                 coalesce(http_status in (503, 429), false)
                 or coalesce(exception = 'HttpRequestException', false) as bad from v_attempts)
    group by w"""
_RECORDS = f"""
        select key as idempotency_key, source_item_id, archive_id, target_archive, target_id, status,
               {_time('extracted')} as extracted_at_utc, {_time('ingested')} as ingested_at_utc,
               {_time('attempted')} as last_attempt_at_utc, attempt_count, code as last_error_code
        from v_folded"""
_DELIVERED = "o_orderkey % 3 = 0"

SQL = {
    "read_archives": "select * from v_archives",
    "read_items": f"""
        select item_id, archive_id, {_time('sent_date_utc')} as sent, cast(2 as bigint) as n_to,
               cast(has_cc as bigint) as n_cc, cast(has_bcc as bigint) as n_bcc,
               'body-' || item_id as part_ids, size_bytes from v_items""",
    "read_parts": """
        select part_id, sha256, size_bytes, part_id || '.bin' as data_ref from v_parts""",
    "read_receipts": """
        select ingest_status, count(*) as receipts, count(distinct key) as keys
        from v_attempts group by ingest_status""",
    "order_items": "select archive_id, item_id, size_bytes from v_items",
    "blob_hashes": """
        select part_id, sha256(payload) as sha256, strlen(payload) as blob_bytes from v_blobs""",
    "identity_entries": """
        select upper(c_name) as owner_key, 'new-' || c_custkey as mapped_target from customer""",
    "recipient_lists": """
        select item_id, sender || ';' || team as to_line, case when has_cc then team end as cc_line,
               case when has_bcc then sender end as bcc_line,
               case when has_cc then '["' || team || '"]' else '[]' end as cc_json from v_items""",
    "policy_outcomes": _outcomes(_decided()),
    "policy_outcomes_filtered": _outcomes(_decided(_FILTERED)),
    "policy_outcomes_hold_migrate": _outcomes(_decided(retain=False)),
    "policy_extra_rules": f"""
        select outcome, reason, count(*) as items
        from ({_decided("case when size_bytes > 300000 then 'Item is too large.' end")}) group by all""",
    "items_in_scope": f"""
        select item_id, folder_path, {_time('sent_date_utc')} as sent from v_items
        where sent_date_utc >= timestamp '1994-01-01' and sent_date_utc < timestamp '2000-01-01'
          and lower(folder_path) like 'inbox%' and lower(retention_category) = 'legal-7y'""",
    "archive_scope": f"""
        select 'item:' || outcome as scope, count(*) as n from ({
            _decided("case when archive_id <> 'arc-7' then 'ArchiveId filter not matched.' end")
        }) group by outcome
        union all
        select 'archive:' || case when archive_id <> 'arc-7' then 'filtered' when legal_hold then 'held'
                                  when orphan_reason is not null then 'orphan' else 'routed' end, count(*)
        from v_routes group by 1""",
    "routed_item_counts": f"""
        select case when outcome in ('SkippedByFilter', 'Orphaned', 'LegalHoldRetain') then 'skipped'
                    else 'go' end as branch, count(*) as items, cast(sum(size_bytes) as bigint) as bytes
        from ({_decided(_FILTERED)}) group by 1""",
    "archive_routing": """
        select archive_id, type, target_archive, orphan_reason,
               case when legal_hold then 'held' when orphan_reason is not null then 'orphan'
                    else 'routed' end as route from v_routes""",
    "orphan_archives": """
        select archive_id, owner_upn, orphan_reason from v_routes where orphan_reason is not null""",
    "held_archives": "select archive_id, vault_store from v_archives where legal_hold",
    "identity_map_stats": """
        select count(distinct lower(owner_upn)) filter (orphan_reason is null) as mapped_upns,
               count(distinct lower(owner_upn)) filter (orphan_reason = 'Unmapped') as orphaned_upns
        from v_routes where type = 'Mailbox'""",
    "orphaned_owners": """
        select distinct lower(owner_upn) as owner_key from v_routes where orphan_reason = 'Unmapped'""",
    "idempotency_keys": """
        select item_id, key as idempotency_key, 'sx-' || substr(sha256(key), 1, 32) as target_id
        from (select item_id, 'ev:' || vault_store || ':' || archive_id || ':' || item_id as key
              from v_items join v_archives using (archive_id))""",
    "parse_keys": r"""
        select key_text, regexp_extract(key_text, '(?s)^ev:([^:]*):([^:]*):(.*)$', 1) as key_vault_store,
               regexp_extract(key_text, '(?s)^ev:([^:]*):([^:]*):(.*)$', 2) as key_archive_id,
               regexp_extract(key_text, '(?s)^ev:([^:]*):([^:]*):(.*)$', 3) as key_item_id
        from v_parsed where valid""",
    "invalid_keys": "select key_text, count(*) as n from v_parsed where not valid group by key_text",
    "content_hashes": "select doc_id, sha256(text) as sha256 from documents",
    "hash_duplicates": """
        select sha256(text) as sha256, count(*) as copies, min(doc_id) as first_doc
        from documents group by 1 having count(*) > 1""",
    "normalized_hashes": """
        select doc_id, case when doc_id % 4 in (0, 3) then sha256(text) end as sha256 from documents""",
    "short_run_ids": "select run_id || '-00' as short_id, status from v_runs",
    "snake_case_columns": """
        select l_orderkey as order_key, l_linenumber as line_number_value, l_returnflag as utc_flag
        from lineitem""",
    "part_verification": "select part_id, sha256, size_bytes, error from v_verified",
    "rehydrated_items": "select item_id, n_parts, bytes, error_code from v_content",
    "rehydration_error_parts": """
        select b.item_id, b.error as error_code, b.pos as error_pos, b.part_id as error_part,
               p.sha256 as error_stored_sha256, v.sha256 as error_sha256
        from v_bad b left join v_parts p on b.part_id = p.part_id
             left join v_verified v on b.part_id = v.part_id""",
    "rehydration_errors": """
        select coalesce(error_code, 'OK') as status, count(*) as items,
               count(*) filter (n_parts = 0) as empty from v_content group by 1""",
    "checked_parts": "select item_id, pos, part_id, sha256, size_bytes, error from v_checked",
    "distinct_part_ids": "select distinct 'prt-' || l_partkey as part_id from lineitem",
    "item_part_lists": """
        select item_id,
               string_agg(part_id || '=' || coalesce(sha256, '?'), ';' order by pos) as part_list
        from v_checked group by 1""",
    "conversation_assembly": """
        select 'conv-' || conv_id as item_id, count(*) as n_parts,
               string_agg('conv-' || conv_id || '-' || turn || '=' || sha256(text), ';' order by turn)
               as part_list
        from conversations group by conv_id""",
    "archive_class": """
        select archive_id,
               case type when 'Mailbox' then 'user_mailbox' when 'Journal' then 'compliance_journal'
                    else 'file_archive' end as archive_class,
               case type when 'Mailbox' then 'unknown:' when 'Journal' then 'compliance_journal:'
                    else 'file_archive:' end || archive_id as type_target
        from v_archives""",
    "item_metadata": f"""
        select item_id,
               case when has_bcc then 'bcc=' || sender || '|' else '' end
               || case when has_cc then 'cc=' || team || '|' else '' end
               || 'folderPath=' || folder_path || '|from=' || sender
               || case when type = 'Journal' then '|immutable=true' else '' end
               || '|messageClass=' || message_class || '|sentDateUtc=' || {_iso('sent_date_utc')}
               || case when type = 'Fsa' then '|sourceFolderPath=' || folder_path else '' end
               || '|subject=' || subject || '|to=' || sender || ';' || team as metadata
        from v_items join v_routes using (archive_id) where orphan_reason is null""",
    "retention_expiry": f"""
        select o_orderkey, years,
               case when years is null or not in_range then null
                    else {_time('sent + to_years(cast(years as int))')} end as expires,
               in_range, {_iso('sent')} as sent_iso
        from (select *, coalesce(years <= 9999 - year(sent), true) as in_range
              from (select o_orderkey,
                           case o_orderkey % 5 when 0 then 7 when 1 then 1 when 3 then 9000 end::bigint
                               as years,
                           case when o_orderkey % 4 = 0 then timestamp '2024-02-29 10:11:12.123456'
                                else o_orderdate end as sent
                    from orders))""",
    "messages_flat": f"""
        select 'ev:' || vault_store || ':' || archive_id || ':' || item_id as idempotency_key,
               target_archive,
               case type when 'Mailbox' then 'user_mailbox' when 'Journal' then 'compliance_journal'
                    else 'file_archive' end as archive_class,
               vault_store, retention_category as category,
               {_time('''sent_date_utc + to_years(case retention_category when 'Legal-7Y' then 7
                        when 'Finance-10y' then 10 when 'Standard-3Y' then 3
                        when 'Archive-1Y' then 1 end)''')} as expires,
               legal_hold, {_AS_OF} as extracted, 'run-batch' as run_id, '1.0.0' as tool_version
        from v_items join v_routes using (archive_id) where orphan_reason is null""",
    "already_migrated": f"""
        select 'itm-' || o_orderkey as item_id,
               'ev:VS-1:arc-' || o_custkey || ':itm-' || o_orderkey as idempotency_key
        from orders where {_DELIVERED}""",
    "pending_items": f"""
        select 'itm-' || o_orderkey as item_id,
               'ev:VS-1:arc-' || o_custkey || ':itm-' || o_orderkey as idempotency_key
        from orders where not ({_DELIVERED})""",
    "ingest_receipts": """
        select key as idempotency_key, 'sx-' || substr(sha256(key), 1, 32) as target_id,
               rn > 1 as deduped, false as already_present from v_docs""",
    "ingest_replay": """
        select key as idempotency_key, seq,
               case when order_key % 5 = 0 then 'sx-old-' || order_key
                    else 'sx-' || substr(sha256(key), 1, 32) end as target_id,
               case when order_key % 5 = 0 then order_key % 2 = 0 else coalesce(deduped, false) end as deduped,
               order_key % 5 = 0 or seq > order_key as already_present
        from v_seqs left join v_use_totals on order_key = l_orderkey""",
    "item_part_rollup": """
        select 'ev:VS-1:itm-' || l_orderkey as idempotency_key, n_parts, bytes, deduped from v_use_totals""",
    "part_store_after": """
        select sha as sha256, 'doc-' || doc_id as part_id, bytes as size_bytes from v_docs where rn = 1""",
    "replay_new_parts": """
        select sha as sha256, 'prt-' || l_partkey as part_id, cast(l_quantity as bigint) as size_bytes
        from v_uses where rn = 1 and not stored""",
    "target_stats": """
        select count(*) as total_ingested, count(*) filter (rn > 1) as deduped_parts,
               count(distinct sha) as unique_parts,
               (select count(*) from v_attempts where http_status = 429) as rejected_429,
               (select count(*) from v_attempts where http_status = 503) as transient_503
        from v_docs""",
    "ingested_by_target": """
        select source as target_archive, count(*) as ingested from documents group by source""",
    "classify_receipts": """
        select http_status, exception, ingest_status, error_code, count(*) as n,
               count(target_id) as with_target, count(retry_after) as with_delay
        from v_attempts group by 1, 2, 3, 4""",
    "attempt_rollup": """
        select key as idempotency_key, attempts, ingest_status, error_code, target_id,
               coalesce(retryable_raw, false) as retryable,
               coalesce(retryable_raw, false) and attempts > 5 as exhausted
        from v_rollup""",
    "retry_queue": f"""
        select key as idempotency_key, attempts, round(delay, 3) as delay_seconds,
               {_time('ts + to_microseconds(cast(delay * 1000000 as bigint))')} as due_at
        from (select *, coalesce(retry_after, 0.5 * pow(2, attempts - 1)) as delay from v_rollup
              where coalesce(retryable_raw, false) and attempts <= 5)""",
    "failure_ratio": _RATIO,
    "sliding_failure_share": f"""
        select {_time('ts')} as at_utc, cast(n as bigint) as deliveries, cast(f as bigint) as failures,
               round(f / n, 6) as failure_share, f / n >= 0.5 and n >= 2 as tripped
        from (select ts, sum(n) over w as n, sum(f) over w as f
              from (select ts, count(*) as n,
                           count(*) filter (coalesce(http_status in (503, 429), false)
                                            or coalesce(exception = 'HttpRequestException', false)) as f
                    from v_attempts group by ts)
              window w as (order by epoch_us(ts) range between 3599999999 preceding and current row))""",
    "apply_receipts": """
        select 'itm-' || doc_id as item_id,
               case ingest_status when 'Ingested' then 'ItemMigrated' when 'AlreadyPresent' then 'ItemMigrated'
                    when 'TransientError' then 'ItemTransientFailed'
                    when 'PermanentError' then 'ItemPermanentFailed' else 'Deliver' end as event_type,
               target_id, error_code as delivery_error
        from documents left join v_rollup on 'key-' || (doc_id * 3 % 5000) = key""",
    "merge_records": _RECORDS,
    "records_compacted": _RECORDS,
    "records_by_status": """
        select key as idempotency_key, code as last_error_code from v_folded where status = 'Failed'""",
    "count_by_status": "select status, count(*) as records from v_folded group by status",
    "find_by_keys": """
        select key as idempotency_key, status from v_folded
        where key in (select 'ev:VS-1:arc-' || (doc_id // 40) || ':itm-' || doc_id from documents)""",
    "find_by_key": """
        select key as idempotency_key, status, attempt_count from v_folded
        where key = 'ev:VS-1:arc-1:itm-47'""",
    "save_checkpoints": f"""
        select run_id, phase, {_time('max(ts)')} as created_at_utc, arg_max(metadata, ts) as metadata
        from v_checkpoints group by run_id, phase""",
    "latest_checkpoint": f"""
        select run_id, arg_max(phase, ts) as phase, {_time('max(ts)')} as created_at_utc,
               arg_max(metadata, ts) as metadata
        from v_checkpoints group by run_id""",
    "run_counters": f"""
        select run_id, {_ARCHIVE_COUNTS}, {_ZERO} as orphaned, {_ZERO} as held_archives, count(*) as total_items
        from v_item_events group by run_id""",
    "run_summary": _SUMMARY.format(none="0", more=""),
    "archive_summary": f"""
        select run_id, archive_id, {_ARCHIVE_COUNTS} from v_item_events group by run_id, archive_id""",
    "run_list": f"select run_id, status, {_time('started_at_utc')} as started_at_utc from v_runs",
    "run_detail": _SUMMARY.format(none="null", more=", r.status"),
    "run_kpis": """
        select count(*) as total, count(*) filter (status = 'Completed') as completed,
               count(*) filter (status = 'Running') as running,
               cast(floor(100.0 * count(*) filter (status = 'Completed') / count(*) + 0.5) as bigint)
               as success_rate
        from v_runs""",
    "resumable_runs": "select run_id, status from v_runs where status in ('Failed', 'Cancelled')",
    "filter_runs": "select run_id, status from v_runs where lower(status) like '%compl%'",
    "recent_runs": f"""
        select run_id, status, {_time('started_at_utc')} as started_at_utc
        from (select * from v_runs order by started_at_utc desc, run_id limit 3)""",
    "last_completed_run": f"""
        select run_id, status, {_time('started_at_utc')} as started_at_utc
        from (select * from v_runs where status = 'Completed' order by started_at_utc desc, run_id limit 1)""",
    "status_changes": f"""
        select run_id, {_time('last')} as timestamp_utc, 'Running' as previous_status, status
        from v_run_totals join v_runs using (run_id) where status in ('Completed', 'Failed')""",
    "archive_catalog": """
        select type, count(*) as archives, count(*) filter (legal_hold) as held, count(owner_upn) as owned
        from v_archives group by type""",
    "audit_for_run": f"""
        select id, {_time('timestamp_utc')} as timestamp_utc, event_type, item_id, payload, run_id
        from v_audit where run_id = 'run-2'""",
    "audit_by_type": """
        select id, event_type, payload from v_audit
        where run_id = 'run-1' and event_type in ('ItemMigrated', 'RunStarted')""",
    "collect_audit": "select run_id, event_type, count(*) as n from v_audit group by all",
    "audit_search": """
        select id, item_id, event_type from v_audit
        where event_type = 'ItemMigrated' and lower(item_id) like '%itm-99%'""",
    "audit_search_indexed": """
        select id, item_id, event_type from v_audit
        where event_type = 'ItemMigrated' and lower(item_id) like '%itm-99%'""",
    "filtered_ratio": """
        select count(*) filter (lower(event_type) like '%fail%' or lower(item_id) like '%fail%') as filtered,
               count(*) as total from v_audit""",
    "error_events": """
        select id, event_type, payload from v_audit
        where event_type in ('ItemPermanentFailed', 'ItemTransientFailed', 'ItemUnexpectedError')""",
    "error_breakdown": """
        select run_id, event_type, error_code, count(*) as failures
        from v_item_events where error_code is not null group by all""",
    "event_types": "select distinct event_type from v_audit",
    "ingest_histogram": f"select run_id, {_time('m')} as minute, ingested from ({_HISTOGRAM})",
    "ingest_histogram_of_day": """
        select run_id, strftime(timestamp_utc, '%H:%M') as minute_of_day, count(*) as ingested
        from v_item_events where event_type = 'ItemMigrated' group by all""",
    "cumulative_ingested": f"""
        select run_id, {_time('m')} as minute, ingested,
               cast(sum(ingested) over (partition by run_id order by m) as bigint) as cumulative
        from ({_HISTOGRAM})""",
    "progress_marks": f"""
        select run_id, {_time('timestamp_utc')} as timestamp_utc, item_id, processed_count
        from (select *, row_number() over (partition by run_id order by timestamp_utc, id) as processed_count
              from v_item_events
              where event_type in ('ItemMigrated', 'ItemTransientFailed', 'ItemPermanentFailed'))
        where processed_count % 10 = 0""",
    "reconcile_totals": """
        select run_id, l as local_total, t as target_total, greatest(l - t, 0) as missing,
               greatest(t - l, 0) as unexpected,
               case when l > t then (l - t) || ' item(s) recorded as migrated locally but not confirmed in the target'
                    when t > l then (t - l) || ' item(s) in the target exceed the local records of run ' || run_id
               end as note, l = t as is_clean
        from (select run_id, count(*) filter (event_type in ('ItemMigrated', 'ItemAlreadyPresent')) as l,
                     (select count(*) from documents) as t
              from v_audit group by run_id)""",
    "reconcile_totals_unavailable": f"""
        select run_id, count(*) filter (event_type in ('ItemMigrated', 'ItemAlreadyPresent')) as local_total,
               cast(-1 as bigint) as target_total, {_ZERO} as missing, {_ZERO} as unexpected,
               'target stats unavailable, cannot reconcile' as note, false as is_clean
        from v_audit group by run_id""",
    "reconcile_items": """
        select key as idempotency_key,
               case when not there then 'missing' when not ours then 'unexpected' else 'mismatched' end as kind,
               case when ours and there then concat_ws(',', case when d_archive then 'target_archive' end,
                                                       case when d_hold then 'legal_hold' end)
                    else '' end as detail
        from v_compare where not there or not ours or d_archive or d_hold""",
    "reconcile_parts": """
        select key as idempotency_key, 'mismatched' as kind,
               concat_ws(',', case when d_archive then 'target_archive' end,
                         case when d_hold then 'legal_hold' end, 'parts') as detail
        from v_compare where ours and there and d_parts""",
    "reconciliation_verdict": """
        select count(*) filter (not there) as missing, count(*) filter (not ours) as unexpected,
               count(*) filter (ours and there and (d_archive or d_hold or d_parts)) as mismatched,
               count(*) filter (not there or not ours or d_archive or d_hold or d_parts) = 0 as is_clean
        from v_compare""",
    "constraint_violations": "select rule, count(*) as violations from v_broken group by rule",
    "constraint_violation_rows": "select row_key, rule from v_broken",
    "illegal_transitions": """
        select key, event_id, previous_status, status
        from (select *, lag(status) over (partition by key order by ts, event_id) as previous_status
              from v_history)
        where previous_status is not null
          and (previous_status, status) not in (('Discovered', 'Mapped'), ('Mapped', 'Rehydrated'),
                                                ('Failed', 'Rehydrated'), ('Ingesting', 'Failed'))""",
    "dry_run_events": """
        select case when error_code is null then 'ItemDryRun' else 'ItemPermanentFailed' end as event_type,
               count(*) as n from v_run_items group by 1
        union all select 'ArchiveLegalHoldRetained', count(*) from v_routes where legal_hold
        union all select 'ArchiveOrphaned', count(*) from v_routes
                  where not legal_hold and orphan_reason is not null
        union all select 'RunStarted', 1 union all select 'RunCompleted', 1""",
    "dry_run_archive_summary": f"""
        select 'run-batch' as run_id, archive_id, count(*) filter (error_code is null) as migrated,
               {_ZERO} as already_present, {_ZERO} as skipped,
               count(*) filter (error_code is not null) as failed
        from v_run_items group by archive_id""",
    "dry_run_error_payloads": """
        select item_id, archive_id, error_code from v_run_items where error_code is not null""",
    "migration_run": _run_totals("run-batch"),
    "migration_resume": _run_totals("run-second", second=True),
    "resume_same_run": f"""
        select 0 as step, count(*) filter (good) as migrated, {_ZERO} as already_present,
               {_ZERO} as skipped, count(*) filter (bad) as failed, count(*) as total_items,
               (select count(*) from v_answers where good) as delivered from v_answers
        union all
        select 1, 0, count(*) filter (good and {_INBOX}), count(*) filter (not {_INBOX}),
               count(*) filter (bad and {_INBOX}), count(*), (select count(*) from v_answers where good) from v_answers
        union all
        select 2, 0, count(*) filter (good), 0, count(*) filter (bad), count(*),
               (select count(*) from v_answers where good) from v_answers""",
    "run_retry_queue": f"""
        select key as idempotency_key, attempts,
               {_time('ts + to_microseconds(cast(delay * 1000000 as bigint))')} as due_at
        from (select *, case when k between 75 and 84 then k % 5 + 1
                             else 0.5 * pow(2, attempts - 1) end as delay
              from v_answers where error_code is null and (k between 60 and 84 or k between 93 and 96))""",
    "own_run_reports": f"""
        select 'checkpoint' as what, 'Ingest' as phase, count(*) filter (good or bad) as n from v_answers
        union all
        select 'rate', {_time("date_trunc('minute', ts)")}, count(*) from v_answers where good group by 2""",
    "outbox_messages": f"""
        select key as idempotency_key,
               case type when 'Mailbox' then 'user_mailbox' when 'Journal' then 'compliance_journal'
                    else 'file_archive' end as archive_class,
               target_archive, case when has_cc then team end as cc, {_iso('sent_date_utc')} as sent,
               strftime(sent_date_utc + to_years(case retention_category when 'Legal-7Y' then 7
                        when 'Finance-10y' then 10 when 'Standard-3Y' then 3
                        when 'Archive-1Y' then 1 end), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as expires,
               n_parts, r.part_id as first_part, false as has_null
        from v_run_items i left join v_refs r on i.item_id = r.item_id and r.pos = 0
        where error_code is null""",
    "outbox_long_lists": """
        select 'ev:VS-1:arc-1:grp-' || (o_custkey // 50) as idempotency_key, count(l_orderkey) as n_parts,
               sha256(coalesce(string_agg('prt-' || l_partkey, ','
                                          order by l_orderkey, l_linenumber, l_partkey), '')) as parts_sha256
        from orders left join lineitem on l_orderkey = o_orderkey group by o_custkey // 50""",
    "audit_csv_export": """
        select id, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as timestamp_utc, event_type,
               item_id, payload, run_id from v_audit where run_id = 'run-0'""",
    "audit_json_export": """
        select id, strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as timestamp_utc, event_type,
               item_id is not null as has_item, payload from v_audit where run_id = 'run-0'""",
    "read_state": """
        select id, run_id, event_type, item_id from v_audit
        where run_id = 'run-1' and event_type in ('ItemMigrated', 'ItemSkipped')""",
    "target_registry": """
        select 'ev:VS-1:itm-' || o_orderkey as idempotency_key, 'sx-old-' || o_orderkey as target_id,
               'tgt-' || o_custkey as target_archive, o_orderkey % 2 = 0 as deduped
        from orders where o_orderkey % 5 = 0""",
    "stream_migration": _run_totals("run-batch"),
    "stream_restart": _run_totals("run-batch"),
    "stream_checkpoints": """
        select 'run-batch' as run_id, 'Ingest' as phase, count(*) as processed from v_run_items""",
    "stream_dedup_watermark": """
        select key as idempotency_key, cast(1 as bigint) as rows from v_attempts group by key""",
    "stream_ingest_rate": f"select run_id, {_time('m')} as minute, ingested from ({_HISTOGRAM})",
    "stream_failure_ratio": _RATIO,
    "stream_dedup_keys": """
        select key as idempotency_key, arg_min(event_id, (ts, event_id)) as event_id
        from v_attempts group by key""",
    "status_tracker": """
        select key, arg_max(status, (ts, event_id)) as status, count(*) as changes,
               count(*) filter (before is not null and (before, status) not in (
                   ('Discovered', 'Mapped'), ('Mapped', 'Rehydrated'),
                   ('Failed', 'Rehydrated'), ('Ingesting', 'Failed'))) as illegal
        from (select *, lag(status) over (partition by key order by ts, event_id) as before
              from v_history) group by key""",
    "stream_answers": f"""
        select s.idempotency_key, {_time("sent_at")} as sent_at, {_time("ts")} as answered_at,
               case when ts is null then 'ItemTransientFailed' when k < 60 then 'ItemMigrated'
                    when k between 85 and 92 then 'ItemPermanentFailed' else 'ItemTransientFailed'
               end as event_type,
               case when ts is null then 'NO_ANSWER' else error_code end as error_code
        from (select 'itm-' || o_orderkey as idempotency_key, o_orderkey as n,
                     timestamp '2024-01-01' + to_seconds(o_orderkey
                         * (2592000 // (select max(event_id) + 1 from events))) as sent_at
              from orders) s
        left join v_attempts a
          on a.event_id = n and ts >= sent_at and ts <= sent_at + interval 12 hours""",
    "stream_second_source": _run_totals("run-batch"),
    "retry_loop": """
        with t as (
            select i.item_id, event_id % 3 + 1 as n, k, k between 60 and 84 or k between 93 and 96 as again,
                   min(case when k < 60 then event_id % 3 + 1 end) over (partition by i.item_id) as good
            from v_attempts a join v_run_items i on i.item_id = 'itm-' || (a.event_id // 3)
            where i.error_code is null
        ), c as (select * from t where good is null or n <= good)
        select case when good is null then 'Failed' else 'Migrated' end as what,
               count(distinct item_id) + any_value(case when good is null then bad else 0 end) as n,
               cast(count(*) + any_value(case when good is null then bad else 0 end) as bigint) as attempts
        from c, (select count(*) as bad from v_run_items where error_code is not null)
        group by good is null, 1
        union all
        select 'open', count(*), 0 from (
            select item_id from c where good is null group by item_id having arg_max(again, n))
        union all
        select 'sent', (select count(*) from v_run_items where error_code is null) + count(*), 0
        from c where again""",
    "replaced_parts": """
        with b as (
            select part_id, cast(substr(part_id, 5) as bigint) as n,
                   payload || case when cast(substr(part_id, 5) as bigint) % 3 = 0 then '-v2' else '' end as good
            from v_blobs
        ), x as (
            select coalesce(p.part_id, b.part_id) as part_id,
                   sha256(good || case when n % 31 = 0 then '!' else '' end) as sha256,
                   case when n % 3 = 0 then sha256(good) else lower(p.sha256) end as stated,
                   case when p.part_id is null then null when n % 3 = 0 then strlen(good)
                        else p.size_bytes end as size_bytes,
                   b.part_id is null as gone, p.part_id is null as unknown
            from v_parts p full join b on p.part_id = b.part_id
        )
        select distinct r.part_id, x.sha256, x.size_bytes,
               case when x.part_id is null or gone then 'BLOB_NOT_FOUND' when unknown then 'PART_NOT_FOUND'
                    when stated <> x.sha256 then 'HASH_MISMATCH' end as error
        from v_refs r join v_run_items i on r.item_id = i.item_id left join x on r.part_id = x.part_id
        where cast(substr(r.item_id, 5) as bigint) % 2 = 1""",
    "blob_files": """
        select 'doc-' || doc_id as part_id, sha256(t) as sha256, strlen(t) as blob_bytes
        from (select doc_id, case when doc_id % 10 = 0 then '' else coalesce(text, '') end as t from documents)""",
    "outbox_sink": """
        select key as idempotency_key,
               case type when 'Mailbox' then 'user_mailbox' when 'Journal' then 'compliance_journal'
                    else 'file_archive' end as archive_class, target_archive
        from v_run_items where error_code is null""",
    "target_parts_approx": "select count(*) as parts, true as near from documents",
    "identity_document": """
        select c_name as upn, 'tgt-' || c_custkey || '-1' as target_archive from customer""",
    "outbox_sink_stream": "select doc_id, lang as archive_class, n_chars from documents",
}
# The same results by another way.
SQL["status_tracker_out_of_order"] = SQL["status_tracker"]
SQL["reconcile_digests"] = SQL["reconcile_items"]
SQL["stream_rate_windows"] = SQL["stream_ingest_rate"]


def _needed(sql: str) -> list[str]:
    """Views a statement uses, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\bv_\w+", todo.pop()):
            if name in VIEWS and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def oracle_statements() -> dict[str, str]:
    """Complete statement per query name."""
    statements = {}
    for name, sql in SQL.items():
        views = ", ".join(f"{v} as ({VIEWS[v]})" for v in _needed(sql))
        body = sql.strip()
        if views and body.startswith("with "):
            statements[name] = f"with {views}, {body[5:]}"
        else:
            statements[name] = f"with {views} {body}" if views else sql
    return statements
