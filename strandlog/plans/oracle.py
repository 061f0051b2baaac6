"""DuckDB SQL for the registered queries, formulated apart from them."""

from __future__ import annotations

LOG = (
    "log as (select event_type as queue, cast(row_number() over (partition by event_type order by event_id) as bigint) - 1 as entry_id, "
    "props as data, ts from events)"
)
SEG = (
    "seg as (select queue, cast(floor(entry_id/64) as bigint)+1 as file_id, min(entry_id) as first_id, max(entry_id) as last_id, "
    "count(*) as num_entries, cast(sum(length(data)+28) as bigint) as bytes from log group by queue, cast(floor(entry_id/64) as bigint)+1)"
)

SQL = {
    "compaction_candidates": (
        f'with {LOG}, {SEG}, m as (select queue,max(file_id) cur from seg group by queue) select s.queue,s.file_id from seg s join m on s.queue=m.queue where '
        's.file_id<m.cur'
    ),
    "f_cloud_key": (
        "select distinct event_type, concat('fleet/', substr(concat('/inst0/',event_type),2), '/001/0a0.store') as k from events"
    ),
    "f_segment_path": (
        f"with {LOG}, {SEG} select queue,file_id,concat('/data/inst0/',queue,'/wal/',lpad(lower(hex(file_id)),3,'0'),'.wal') as path from seg"
    ),
    "fanout": (
        f"with {LOG}, {SEG}, subs as (select * from (values (0,'click',cast(1990 as bigint),cast(1 as bigint)),(1,'click',cast(1980 as bigint),cast(3 as "
        "bigint)),(2,'view',cast(1900 as bigint),cast(7 as bigint))) v(sub_id,queue,from_id,step)) select s.sub_id,l.queue,l.entry_id,l.data from subs s join "
        'log l on s.queue=l.queue and l.entry_id>=s.from_id and (l.entry_id-s.from_id)%s.step=0'
    ),
    "file_bounds": (
        f'with {LOG}, {SEG} select queue, min(file_id) as first_file, max(file_id) as last_file from seg group by queue'
    ),
    "file_end": (
        f"with {LOG}, {SEG}, c as (select queue,file_id,'WAL' src,1 pri,last_id from seg where file_id>=20 union all select queue,file_id,'STORE',2,last_id-1 "
        'from seg where file_id<=24), e as (select queue,file_id,max(last_id) as end_id from c group by queue,file_id), h as (select '
        'queue,file_id,src,row_number() over (partition by queue,file_id order by pri) rn from c) select e.queue,e.file_id,e.end_id,h.src as header_src from e '
        'join h on e.queue=h.queue and e.file_id=h.file_id where h.rn=1'
    ),
    "flush_ack_coalesce": (
        f"with {LOG}, {SEG} select queue,date_trunc('hour',ts) as flush,max(entry_id) as acked_id,count(*) as n from log group by queue,date_trunc('hour',ts)"
    ),
    "last_id_status": (
        f"with {LOG}, {SEG}, r(queue) as (select * from (values ('click'),('view'),('nosuch')) v(queue)) select r.queue, max(l.entry_id) as last_id, case when "
        "count(l.entry_id)=0 then 'QUEUE_NOT_FOUND' else 'OK' end as status from r left join log l on r.queue=l.queue group by r.queue"
    ),
    "latency_nearest_rank": (
        'with x as (select event_type,value,cast(row_number() over (partition by event_type order by value) as bigint)-1 as i,count(*) over (partition by '
        'event_type) as n from events) select event_type, max(case when i=floor(n*50/100) then value end) as p50, max(case when i=floor(n*95/100) then value '
        'end) as p95, max(case when i=floor(n*99/100) then value end) as p99 from x group by event_type'
    ),
    "mem_budget": (
        'with q as (select event_type as queue, cast(row_number() over (order by min(event_id)) as bigint)-1 as existing from events group by event_type) '
        'select queue, cast(floor(268435456/greatest(existing,1)) as bigint) as budget from q'
    ),
    "mem_evict_acked": (
        f'with {LOG}, {SEG}, u as (select queue,cast(sum(length(data)) as bigint) used from log group by queue) select l.queue,l.entry_id from log l join u on '
        'l.queue=u.queue where not (u.used > 17700 and l.entry_id <= 1900)'
    ),
    "multi_read": (
        f"with {LOG}, reads as (select * from (values (1,'click','ABSOLUTE',cast(10 as bigint),cast(5 as bigint),cast(0 as "
        "bigint)),(2,'view','SHIFT_FROM_TAIL',cast(9 as bigint),cast(4 as bigint),cast(3 as bigint)),(3,'nosuch','ABSOLUTE',cast(0 as bigint),cast(5 as "
        'bigint),cast(1 as bigint))) v(read_id,queue,pos_type,off,lim,step)), n as (select queue,max(entry_id) l from log group by queue), r as (select '
        "read_id,reads.queue,case when pos_type='ABSOLUTE' then off else greatest(l-off,0) end s,lim,greatest(step,1) st from reads left join n on "
        'reads.queue=n.queue) select r.read_id,l.queue,l.entry_id,l.data from r join log l on r.queue=l.queue and l.entry_id between r.s and '
        'r.s+(r.lim-1)*r.st and (l.entry_id-r.s)%r.st=0'
    ),
    "nearest_nonempty": (
        f'with {LOG}, {SEG}, s as (select queue,file_id,case when file_id%5 in (3,4) then 0 else num_entries end n from seg), t as (select queue,file_id from '
        's) select t.queue,t.file_id,max(s.file_id) as nearest from t left join s on t.queue=s.queue and s.file_id<=t.file_id and s.n>0 group by '
        't.queue,t.file_id'
    ),
    "offload_pending": (
        f'with {LOG}, {SEG} select l.queue,l.file_id from seg l left join (select queue,file_id,case when file_id=7 then bytes-1 else bytes end rb from seg '
        'where file_id<=10) r on l.queue=r.queue and l.file_id=r.file_id and l.bytes=r.rb where r.file_id is null'
    ),
    "ordered_release": (
        f'with {LOG}, {SEG}, a as (select queue,entry_id,data from log where entry_id % 501 <> 500), p as (select *, cast(row_number() over (partition by queue '
        'order by entry_id) as bigint)-1 as pos from a) select queue,entry_id,data from p where entry_id=pos'
    ),
    "queue_config_first_match": (
        "with r as (select * from (values (1,'/inst0/c%','NONE'),(2,'/inst0/%','ZSTD')) v(pri,pat,codec)), q as (select distinct concat('/inst0/',event_type) "
        'as queue from events) select queue,codec from (select q.queue,r.codec,row_number() over (partition by q.queue order by r.pri) rn from q join r on '
        'q.queue like r.pat) x where rn=1'
    ),
    "queue_resolve": (
        "select distinct event_type, case when event_type like '/%' then event_type else concat('/inst0/',event_type) end as queue_path from events"
    ),
    "queue_size": (
        f'with {LOG}, {SEG} select queue, cast(sum(bytes) as bigint) as bytes, count(*) as files, sum(bytes) > 60000 as over_limit from seg group by queue'
    ),
    "queue_start": (
        f'with {LOG}, {SEG} select queue, min(first_id) as start_id from seg where file_id>=5 group by queue'
    ),
    "read_absolute": (
        f"with {LOG}, {SEG} select queue,entry_id,data from log where queue='click' and entry_id between 100 and 100+(50-1)*1"
    ),
    "read_absolute_step": (
        f"with {LOG}, {SEG} select queue,entry_id,data from log where queue='view' and entry_id between 7 and 7+(40-1)*20 and (entry_id-7)%20=0"
    ),
    "read_before_first": (
        f"with {LOG}, kept as (select * from log where entry_id >= 640) select queue, entry_id, data from kept where queue='click' and entry_id between 600 and "
        '600+(20-1)*7 and (entry_id-600)%7=0'
    ),
    "read_cross_tier": (
        f"with {LOG}, n as (select queue, max(entry_id) l from log group by queue), tiers as (select log.queue,entry_id,data,'CLOUD' src,4 pri from log where "
        "entry_id<800 union all select queue,entry_id,data,'DISK_STORE',2 from log where entry_id between 640 and 1599 union all select "
        "queue,entry_id,data,'DISK_WAL',3 from log where entry_id>=1536 union all select log.queue,entry_id,data,'MEMORY',1 from log join n on "
        'log.queue=n.queue where entry_id>n.l-50), p as (select *, row_number() over (partition by queue,entry_id order by pri) rn from tiers) select '
        "queue,entry_id,data,src as source from p where rn=1 and queue='view' and entry_id between 600 and 600+(1400-1)"
    ),
    "read_frames": (
        f"with {LOG}, e as (select entry_id,data, cast(row_number() over (order by entry_id) as bigint) seq from log where queue='click' and entry_id between 5 "
        "and 14) select cast(0 as bigint) as seq,'RR_START' as result,cast(null as bigint) as entry_id,cast(null as varchar(100)) as data union all select "
        "seq,'RR_ENTRY',entry_id,data from e union all select (select count(*) from e)+1,'RR_END',null,null"
    ),
    "read_overshoot": (
        f"with {LOG}, {SEG} select queue,entry_id,data from log where queue='signup' and entry_id between 1900 and 1900+(100000-1)"
    ),
    "read_past_end": (
        f"with {LOG} select queue, entry_id, data from log where queue='click' and entry_id between 1000000 and 1000000+(10-1)"
    ),
    "read_tail": (
        f'with {LOG}, {SEG}, t as (select queue, greatest(max(entry_id)-7,0) s from log group by queue) select l.queue,l.entry_id,l.data from log l join t on '
        'l.queue=t.queue where l.entry_id between t.s and t.s+(8-1)*1'
    ),
    "read_tail_clamped": (
        f'with {LOG}, {SEG}, t as (select queue, greatest(max(entry_id)-1000000,0) s from log group by queue) select l.queue,l.entry_id,l.data from log l join '
        't on l.queue=t.queue where l.entry_id between t.s and t.s+(5-1)*1'
    ),
    "read_tail_step": (
        f'with {LOG}, {SEG}, t as (select queue, greatest(max(entry_id)-60,0) s from log group by queue) select l.queue,l.entry_id,l.data from log l join t on '
        'l.queue=t.queue where l.entry_id between t.s and t.s+(4-1)*13 and (l.entry_id-t.s)%13=0'
    ),
    "recover_end": (
        f'with {LOG}, {SEG}, m as (select queue,max(file_id) latest from seg group by queue), e as (select queue,max(file_id) f,max(last_id) l from seg where '
        'num_entries>0 group by queue) select m.queue, case when e.f=m.latest then m.latest+1 else m.latest end as next_file_id, e.l+1 as next_entry_id from m '
        'join e on m.queue=e.queue'
    ),
    "retention_victims": (
        f'with {LOG}, {SEG}, c as (select *, coalesce(sum(bytes) over (partition by queue order by file_id rows between unbounded preceding and 1 preceding),0) '
        'as freed_before, sum(bytes) over (partition by queue) as total from seg) select queue,file_id,bytes from c where freed_before < total - 40000 and '
        'file_id <= 12'
    ),
    "segments": (
        f'with {LOG}, {SEG} select * from seg'
    ),
    "subscribe": (
        f'with {LOG} select queue, cast(floor(entry_id/100) as bigint) as batch, count(*) as n, max(entry_id) as last_sent from log where entry_id>1500 group '
        'by queue, cast(floor(entry_id/100) as bigint)'
    ),
    "tier_bounds": (
        f"with {LOG}, {SEG}, t as (select queue,file_id,case when file_id<=10 then 'CLOUD' when file_id<=25 then 'DISK_STORE' else 'DISK_WAL' end as tier from "
        'seg) select queue,tier,min(file_id) as first_file,max(file_id) as last_file from t group by queue,tier'
    ),
    "tier_fallback": (
        f"with {LOG}, {SEG}, tiers as (select queue,file_id,'DISK_STORE' src,1 pri from seg where file_id%3<>0 union all select queue,file_id,'DISK_WAL',2 from "
        "seg where file_id%2=0 union all select queue,file_id,'CLOUD',3 from seg), pick as (select queue,file_id,src,row_number() over (partition by "
        'queue,file_id order by pri) rn from tiers) select queue,file_id,src from pick where rn=1'
    ),
    "valid_prefix": (
        f'with {LOG}, {SEG}, r as (select queue,entry_id,data,cast(floor(entry_id/64) as bigint)+1 as file_id, case when entry_id%150=149 then 0 else 1 end ok '
        'from log), p as (select *, min(ok) over (partition by queue,file_id order by entry_id rows between unbounded preceding and current row) m from r) '
        'select queue,file_id,entry_id,data from p where m=1'
    ),
    "segment_assign": """
with recursive e as (select source as queue, cast(row_number() over (partition by source order by doc_id) as bigint)-1 as entry_id, n_chars as n from documents),
g as (select queue, entry_id, cast(1 as bigint) as file_id, 33+28+n as size from e where entry_id=0 union all
  select e.queue, e.entry_id, case when g.size+e.n>20000 then g.file_id+1 else g.file_id end,
    case when g.size+e.n>20000 then 33+28+e.n else g.size+28+e.n end from g join e on e.queue=g.queue and e.entry_id=g.entry_id+1)
select queue, entry_id, file_id from g
    """,
    "compact": (
        f"with {LOG} select queue, entry_id, data from log"
    ),
    "decode_store": (
        f"with {LOG} select queue, entry_id, data from log"
    ),
    "corrupt_skip": (
        f"with {LOG}, {SEG} select l.queue, s.file_id, l.entry_id, l.data from log l join seg s on l.queue=s.queue and l.entry_id between s.first_id and "
        "s.last_id where not (s.file_id%5=0 and l.entry_id=s.last_id)"
    ),
    "list_files": (
        f"with {LOG} select distinct queue, cast(floor(entry_id/1024) as bigint)+1 as file_id from log"
    ),
    "f_path_to_id": (
        "select o_orderkey*7919 as id, o_orderkey*7919 as back from orders"
    ),
    "f_uint_le": (
        "with h as (select o_orderkey*7919 as id, lpad(lower(hex(o_orderkey*7919)),16,'0') as x from orders) select id, "
        "concat(substr(x,15,2),substr(x,13,2),substr(x,11,2),substr(x,9,2),substr(x,7,2),substr(x,5,2),substr(x,3,2),substr(x,1,2)) as le, id as back from h"
    ),
    "follow_absolute": (
        f"with {LOG} select queue, entry_id, data from log where queue='click' and entry_id>=1500 and (entry_id-1500)%3=0"
    ),
    "follow_tail": (
        f"with {LOG}, t as (select greatest(least(max(entry_id),1899)-60,0) as s from log where queue='click') select queue, entry_id, data from log, t where "
        "queue='click' and entry_id>=t.s and (entry_id-t.s)%7=0"
    ),
    "follow_live": (
        f"with {LOG}, t as (select least(max(entry_id),1899)+1 as s from log where queue='click') select queue, entry_id, data from log, t where queue='click' "
        "and entry_id>=t.s and (entry_id-t.s)%2=0"
    ),
    "f_in_step": (
        'select l_orderkey as id, l_linenumber as step, (l_linenumber=1 or (l_orderkey>=100 and (l_orderkey-100)%l_linenumber=0)) as in_step_ref, '
        '(l_orderkey>=100 and (l_orderkey-100)%l_linenumber=0) as in_step_ours from lineitem'
    ),
    "f_uint_arith": (
        'select l_orderkey as a, l_partkey as b, l_orderkey+l_partkey as s, case when l_orderkey>=l_partkey then l_orderkey-l_partkey end as d, '
        'l_orderkey%greatest(l_partkey,1) as r, cast(floor((l_orderkey+l_partkey)/2) as bigint) as mid from lineitem'
    ),
    "f_uint_width": (
        'select distinct l_orderkey*l_orderkey*97 as v, case when l_orderkey*l_orderkey*97<256 then 1 when l_orderkey*l_orderkey*97<65536 then 2 when '
        'l_orderkey*l_orderkey*97<4294967296 then 4 else 8 end as size_bytes from lineitem'
    ),
    "file_lookup": (
        f'with {LOG}, {SEG} select l.queue,l.entry_id,s.file_id from log l join seg s on l.queue=s.queue and l.entry_id between s.first_id and s.last_id'
    ),
    "batch_id_assign": (
        f'with {LOG}, m as (select queue,max(entry_id) mx from log group by queue) select m.queue, m.mx + cast(row_number() over (partition by m.queue '
        'order by b.c_custkey) as bigint) as entry_id, b.c_name as data from m cross join customer b'
    ),
    "file_path": (
        f"with {LOG}, {SEG}, h as (select distinct file_id*397 as fid from seg) select fid, case when fid<4096 then concat(substr(x,4,3),'.store') else "
        "concat(substr(x,1,3),'/',substr(x,4,3),'.store') end as path from (select fid,lpad(lower(hex(fid)),6,'0') as x from h) y"
    ),
    "multi_read_defaults": (
        f"with {LOG}, n as (select queue,max(entry_id) l from log group by queue), r as (select * from (values (1,'click',0,2,1),(2,'view',4,9,5),(3,'view',6,8,1)) v(read_id,queue,s,e,st) "
        "union all select 4,queue,l,l,1 from n where queue='signup' union all select 5,queue,7,l,100 from n where queue='click') "
        "select cast(r.read_id as integer) as read_id,l.queue,l.entry_id,l.data from r join log l on r.queue=l.queue and l.entry_id between r.s and r.e and (l.entry_id-r.s)%r.st=0"
    ),
    "read_results": (
        "select o_orderkey as read_id, case when o_orderkey%4=3 or o_custkey<20 then 'RR_SERVER_ERROR' when o_orderkey%4<2 then 'RR_END' else 'RR_QUEUE_NOT_FOUND' end as result from orders"
    ),
    "queue_status": (
        f"with {LOG}, r(queue) as (select * from (values ('click'),('fresh'),('nosuch')) v(queue)) select r.queue, max(l.entry_id) as last_id, case when count(l.entry_id)>0 then 'OK' "
        "when r.queue='fresh' then 'QUEUE_EMPTY' else 'QUEUE_NOT_FOUND' end as status from r left join log l on r.queue=l.queue group by r.queue"
    ),
    "wire_write": (
        f"with {LOG}, w as (select o_orderkey as write_id, case when o_orderkey%7=0 then null when o_orderkey%2=0 then 'click' else 'fresh' end as queue, "
        "case when o_orderkey%11=0 then 0 else count(*) end as n from orders join lineitem on o_orderkey=l_orderkey group by o_orderkey), "
        "b as (select *, coalesce(sum(n) over (partition by queue order by write_id rows between unbounded preceding and 1 preceding),0) as before from w), "
        "m as (select queue,max(entry_id)+1 as next from log group by queue), p as (select b.*, coalesce(m.next,0)+before as first from b left join m on b.queue=m.queue) "
        "select write_id, case when queue is null then 'WR_SERVER_ERROR' else 'WR_DONE' end as result, cast(case when queue is not null and n>0 then first end as bigint) as first_id, "
        "cast(case when queue is not null and n>0 then first+n-1 end as bigint) as last_id from p"
    ),
    "queue_modes": (
        "select event_type as queue, case when bool_or(event_type<'p' and event_id%3=0) then 'write' else 'read' end as mode, bool_or(event_type<'p' and event_id%3=0) as admitted from events group by event_type"
    ),
    "latency_nearest_rank_n1": (
        'with x as (select event_type,value,cast(row_number() over (partition by event_type order by value) as bigint)-1 as i,count(*) over (partition by '
        'event_type) as n from events) select event_type, max(case when i=(n-1)*50//100 then value end) as p50, max(case when i=(n-1)*95//100 then value '
        'end) as p95, max(case when i=(n-1)*99//100 then value end) as p99 from x group by event_type'
    ),
    "f_uint_wide": (
        "with w as (select cast(o_orderkey as hugeint)*123456789012345678901::hugeint as v from orders), d as (select v, lpad(lower(hex(cast(v//18446744073709551616::hugeint as ubigint))),16,'0') || "
        "lpad(lower(hex(cast(v%18446744073709551616::hugeint as ubigint))),16,'0') as x from w) "
        "select cast(v as varchar) as v, case when v=0 then 1 else 16 end as size_bytes, array_to_string(list_reverse(regexp_extract_all(x,'..')),'') as le, cast(v as varchar) as back, case when v=0 then cast(0 as bigint) end as narrow from d"
    ),
    "f_uint_more": (
        "with r as (select l_orderkey as a, l_partkey as b, l_linenumber as n from lineitem) select a, b, n, a+1 as up, case when a>0 then a-1 end as down, cast(sign(a-b) as integer) as sign, "
        "case when n=1 or a=0 then a end as narrow, n in (1,2,4,8,16) as is_width, a<256 as one_byte, a<b as key_less from r"
    ),
    "latest_offloaded": (
        f"with {LOG}, {SEG} select queue, max(file_id) as latest from seg where file_id<=10 or file_id%7=0 group by queue"
    ),
    "limit_holds": (
        f"with {LOG}, {SEG} select queue, sum(bytes)>=60000 as holds from seg group by queue"
    ),
    "wal_scan": (
        f"with {LOG}, {SEG} select l.queue, cast(floor(entry_id/64) as bigint)+1 as file_id, entry_id, data from log l where entry_id between 100 and 1500 and (entry_id-100)%7=0"
    ),
    "wal_probe": (
        f"with {LOG}, {SEG}, c as (select *, case when file_id%7=0 then 0 when file_id%5=0 then num_entries-1 else num_entries end as k from seg) "
        "select queue, file_id, case when file_id%7=0 then 'EMPTY' else 'OK' end as status, case when file_id%7<>0 then first_id end as before, case when k>0 then first_id end as first_id, "
        "case when k>0 then first_id+k-1 end as last_id, k as num_entries from c"
    ),
    "wal_header": (
        f"with {LOG}, {SEG} select queue, file_id, 'OK' as status, cast(8 as bigint) as data_width, cast(4 as bigint) as id_width, first_id as before from seg union all "
        "select queue, max(file_id)+1, 'NOT_FOUND', null, null, null from seg group by queue"
    ),
    "store_probe": (
        f"with {LOG}, {SEG} select queue, file_id, 'OK' as status, first_id, last_id, num_entries, first_id as before, cast(4 as bigint) as id_width from seg"
    ),
    "store_problems": (
        f"with {LOG}, {SEG} select queue, file_id from seg where file_id%5=0"
    ),
    "wal_to_store": (
        f"with {LOG}, {SEG}, m as (select queue, max(file_id) as cur from seg group by queue) select l.queue, s.file_id, l.entry_id, l.data, case when s.file_id<m.cur then 'DISK_STORE' else 'DISK_WAL' end as source "
        "from log l join seg s on l.queue=s.queue and l.entry_id between s.first_id and s.last_id join m on m.queue=s.queue"
    ),
    "retention_apply": (
        f"with {LOG}, {SEG}, f as (select queue, file_id, bytes+32+case when first_id<256 then 1 when first_id<65536 then 2 else 4 end as bytes from seg where queue<>'signup'), "
        "c as (select *, coalesce(sum(bytes) over (partition by queue order by file_id rows between unbounded preceding and 1 preceding),0) as freed, sum(bytes) over (partition by queue) as total from f) "
        "select queue, file_id, cast(bytes as bigint) as bytes from c where freed>=total-40000"
    ),
}
