"""Full records, evidence with its citation, and the lists and reports that readers page through."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.functions import strings as S
from lexlake.operators import aggregates, detail, joins, records, sessions
from lexlake.sources import tables as T

from .browse import ACTIONS, BILLS
from .ingest import SESSIONS_SQL, session_rows
from .registry import ORACLE_SQL, query
from .reports import DERIVED_SQL, FATE_SQL, fated, mortality_by_nation


def cut_sql(name: str, rows: str, item: str, order: str, most: int) -> str:
    """A list of the records cut to its first items, with its true number."""
    return f"{name} as (select id, string_agg(item, ',' order by n) filter (n <= {most}) items, max(c) c from (select id, {item} item, row_number() over (partition by id order by {order}) n, count(*) over (partition by id) c from {rows}) group by id)"


def list_columns(name: str, most: int) -> str:
    return f"coalesce({name}.items, '') {name}, coalesce({name}.c, 0) {name}_count, coalesce({name}.c > {most}, false) {name}_truncated"


def joined(column: str, *fields: str):
    """A list's items as one text."""
    item = lambda x: F.concat_ws(":", *(x[f].cast("string") for f in fields))
    return F.coalesce(F.array_join(F.transform(column, item), ","), F.lit("")).alias(column)


A = f"(select *, bill_id id from {ACTIONS})"
RELATED_SQL = f"""(with r as (select id, jurisdiction_id, year, upper(chamber || ' ' || priority) k, case when id % 4 = 0 then 'prior-session' else 'companion' end relation from {BILLS}),
 b as (select jurisdiction_id, year, upper(chamber || ' ' || priority) k, min(id) target_id from {BILLS} where id % 3 = 0 group by all)
 select id, relation, case when relation <> 'prior-session' then target_id end target_id from r left join b using (jurisdiction_id, year, k))"""
FULL = {
    "versions": (f"(select * from {A} where kind like '%F')", "day || ':' || place", "day, place", ["day", "place"]),
    "actions": (A, "place || ':' || part_id || ':' || sponsor_id", "place, part_id, sponsor_id", ["place", "part_id", "sponsor_id"]),
    "sponsors": ("(select distinct l_orderkey id, s_name as name, l_linenumber = 1 lead from lineitem join supplier on s_suppkey = l_suppkey)", "name", "lead desc, name", ["name"]),
    "votes": (f"(select * from {A} where kind like 'R%')", "sponsor_id || ':' || place", "sponsor_id, place", ["sponsor_id", "place"]),
    "documents": (f"(select * from {A} where kind like '%O')", "part_id || ':' || day", "part_id, day", ["part_id", "day"]),
    "related": (RELATED_SQL, "relation || coalesce(':' || target_id, '')", "relation, target_id", ["relation", "target_id"]),
    "subjects": ("(select distinct l_orderkey id, p_type subject from lineitem join part on p_partkey = l_partkey)", "subject", "subject", ["subject"]),
}
FULL_SQL = f"""with {', '.join(cut_sql(n, rows, item, order, 3) for n, (rows, item, order, _) in FULL.items())}
 select b.id, n_name as place, {', '.join(list_columns(n, 3) for n in FULL)} from {BILLS} b left join nation on n_nationkey = b.jurisdiction_id and n_nationkey <> 3 {' '.join(f'left join {n} on {n}.id = b.id' for n in FULL)}"""


def related_rows(spark, d):
    rows = T.bills(spark, d).withColumn("session", F.col("year"))
    ident = F.upper(F.concat_ws(" ", "chamber", "priority"))
    relation = F.when(F.col("id") % 4 == 0, "prior-session").otherwise("companion").alias("relation")
    return detail.related_read(rows.select("id", "jurisdiction_id", "session", ident.alias("k"), relation), rows.where("id % 3 = 0"), "k", "relation", ident)


@query(FULL_SQL)
def record_full_lists(spark, d):
    """Records with all lists that hang on them, cut to three items with their true numbers, and their places."""
    a = T.actions(spark, d).withColumnRenamed("bill_id", "id")
    lead = T.sponsors(spark, d).select(F.col("bill_id").alias("id"), "name", (~F.col("primary")).alias("other")).repartition("id").distinct()  # by the record's key, as the lists are
    lists = {
        "versions": (a.where("kind like '%F'"), ["day", "place"], ["day", "place"]), "actions": (a, ["place", "part_id", "sponsor_id"], ["place", "part_id", "sponsor_id"]),
        "sponsors": (lead, ["other", "name"], ["name"]), "votes": (a.where("kind like 'R%'"), ["sponsor_id", "place"], ["sponsor_id", "place"]),
        "documents": (a.where("kind like '%O'"), ["part_id", "day"], ["part_id", "day"]), "related": (related_rows(spark, d), ["relation", "target_id"], ["relation", "target_id"]),
        "subjects": (T.subjects(spark, d).withColumnRenamed("bill_id", "id").repartition("id").distinct(), ["subject"], ["subject"]),
    }
    places = T.jurisdictions(spark, d).where("jurisdiction_id <> 3")
    out = detail.full_record(T.bills(spark, d).select("id", "jurisdiction_id"), "id", lists, places, "jurisdiction_id", 3)
    return out.select("id", F.col("jurisdiction.code").alias("place"), *(c for n in FULL for c in (joined(n, *FULL[n][3]), f"{n}_count", f"{n}_truncated")))


HISTORY_SQL = f"(select bill_id id, day, 0 source_no, 'action' source, place ordinal, kind what from {ACTIONS} union all select id, day, 1, 'filing', 0, status_code from {BILLS})"
PACKET = {
    "votes": (f"(select * from {A} where kind like 'R%')", "sponsor_id || ':' || place", "sponsor_id, place", 2),
    "hearings": (f"(select * from {A} where kind = 'NO')", "day || ':' || place", "day, place", 2),
    "history": (HISTORY_SQL, "day || ':' || source || ':' || ordinal || ':' || what", "day, source_no, ordinal, what", 4),
}


@query(f"""with {', '.join(cut_sql(n, *x) for n, x in PACKET.items())}, p as (select l_orderkey k, string_agg(l_partkey, ',' order by l_partkey) actions from lineitem group by 1),
 s as (select b.*, n_name code, 'bcs1_' || substr(sha256('id=' || id || ';code=' || coalesce(n_name, '') || ';status_code=' || status_code || ';actions=' || coalesce(actions, '')), 1, 16) as snapshot from {BILLS} b left join nation on n_nationkey = jurisdiction_id left join p on k = id)
 select s.id, snapshot, code || ' ' || upper(substr(chamber, 1, 2)) || ' ' || s.id || ', session ' || year || ', "' || priority || '", ' || case when status_code = 'P' then 'status: not determined' else 'status (derived): ' || status_code end || ', snapshot ' || snapshot cite,
 {', '.join(list_columns(n, x[3]) for n, x in PACKET.items())} from s {' '.join(f'left join {n} on {n}.id = s.id' for n in PACKET)}""")
def evidence_packets(spark, d):
    """Votes, hearings and history with caps and true counts, a snapshot id that no cap changes, and the line that cites it."""
    a = T.actions(spark, d).withColumnRenamed("bill_id", "id")
    bills = joins.with_labels(T.bills(spark, d), T.jurisdictions(spark, d), "jurisdiction_id", "jurisdiction_id", ["code"])
    dated = lambda rows, ordinal, what: rows.select(F.col("id").alias("bill_id"), "day", ordinal.alias("ordinal"), what.alias("what"))
    history = records.timeline({"action": dated(a, F.col("place"), F.col("kind")), "filing": dated(bills, F.lit(0), F.col("status_code"))}).withColumnRenamed("bill_id", "id")
    kinds = {
        "votes": (a.where("kind like 'R%'"), ["sponsor_id", "place"], ["sponsor_id", "place"]), "hearings": (a.where("kind = 'NO'"), ["day", "place"], ["day", "place"]),
        "history": (history, ["day", "source_no", "ordinal", "what"], ["day", "source", "ordinal", "what"]),
    }
    digest = records.evidence(bills, "id", ["code", "status_code"], {"actions": (T.actions(spark, d), "part_id")}).select("id", "snapshot")
    facts = bills.select("id", F.concat_ws(" ", F.upper(F.substring("chamber", 1, 2)), F.col("id").cast("string")).alias("number"), "code", F.col("year").cast("string").alias("session"), "priority", F.when(F.col("status_code") != "P", F.col("status_code")).alias("status"))
    rows = facts.join(digest, "id").select("id", "snapshot", S.citation("number", "code", "session", "priority", "status", "snapshot").alias("cite"))
    out = detail.evidence_packet(rows, "id", kinds, {n: x[3] for n, x in PACKET.items()})
    return out.select("id", "snapshot", "cite", *(c for n, (_, _, fields) in kinds.items() for c in (joined(n, *fields), f"{n}_count", f"{n}_truncated")))


@query("select n_nationkey id, n_name code, count(*) over () total from nation order by n_name, n_nationkey limit 10 offset 10")
def jurisdictions_list(spark, d):
    rows = T.jurisdictions(spark, d).select(F.col("jurisdiction_id").alias("id"), "code")
    return detail.listed(rows, [F.asc("code"), F.asc("id")], 2, 10)


@query(f"select n_name code, year, n, count(*) over () total from {SESSIONS_SQL} join nation on n_nationkey = place where active order by year desc, code limit 25")
def sessions_list(spark, d):
    """The first page of the sessions under way, latest first."""
    rows = joins.with_labels(session_rows(spark, d), T.jurisdictions(spark, d), "place", "jurisdiction_id", ["code"])
    return detail.listed(rows, [F.desc_nulls_last("year"), F.asc("code")], 1, 25, active=True).select("code", "year", "n", "total")


COMMITTEES_SQL = "(select p_brand || '/' || p_type id, p_brand place, p_type as name, count(*) members from part group by all)"


def committees(spark, d):
    rows = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("place"), F.col("p_type").alias("name")).agg(F.count("*").alias("members"))
    return rows.select(F.concat_ws("/", "place", "name").alias("id"), "place", "name", "members")


@query(f"select id, members, count(*) over () total from {COMMITTEES_SQL} order by name, id limit 20 offset 20")
def committees_list(spark, d):
    return detail.listed(committees(spark, d), [F.asc("name"), F.asc("id")], 2, 20).select("id", "members", "total")


@query(f"select id, place, name, members from {COMMITTEES_SQL} where id = 'Brand#13/ECONOMY'")
def committee_detail(spark, d):
    return detail.listing(committees(spark, d), ["id"], 0, 1, id="Brand#13/ECONOMY")


@query(f"select bill_id, place, part_id, cast(day as varchar) as day, code, count(*) over () total from (select a.*, n_name code from {ACTIONS} a left join nation on n_nationkey = part_id % 30 where kind = 'NO') where code = 'NATION_7' order by day desc, bill_id, place, part_id limit 30")
def hearings_list(spark, d):
    """A place's hearings, latest first; hearings without a place are in no place's list."""
    rows = T.actions(spark, d).where("kind = 'NO'").withColumn("of", F.col("part_id") % 30)
    rows = joins.with_labels(rows, T.jurisdictions(spark, d), "of", "jurisdiction_id", ["code"])
    out = detail.listed(rows, [F.desc_nulls_last("day"), F.asc("bill_id"), F.asc("place"), F.asc("part_id")], 1, 30, code="NATION_7")
    return out.select("bill_id", "place", "part_id", F.col("day").cast("string").alias("day"), "code", "total")


@query("select event_id id, user_id entity_id, count(*) over () total from events where event_type = 'signup' order by ts desc, event_id limit 50 offset 50")
def sources_list(spark, d):
    """The second page of what was retrieved for one type of entity, latest first."""
    rows = T.change_log(spark, d).select(F.col("seq").alias("id"), F.col("kind").alias("entity_type"), "entity_id", "changed_at")
    return detail.listed(rows, [F.desc_nulls_last("changed_at"), F.asc("id")], 2, 50, entity_type="signup").select("id", "entity_id", "total")


@query(f"with m as ({ORACLE_SQL['mortality_by_nation']}) select m.*, case when not is_total then code in (select n_name from {SESSIONS_SQL} join nation on n_nationkey = place where active and n > 10) end has_active from m")
def mortality_with_active(spark, d):
    live = joins.with_labels(session_rows(spark, d).withColumn("active", F.col("active") & (F.col("n") > 10)), T.jurisdictions(spark, d), "place", "jurisdiction_id", ["code"])
    return aggregates.with_active(mortality_by_nation(spark, d), "code", live, "active")


@query(f"select jurisdiction_id place, count(*) n from (select jurisdiction_id, year, {FATE_SQL} as status from {BILLS} left join {DERIVED_SQL} on bill_id = id) where status = 'died_on_adjournment' and year >= 1995 group by 1")
def contradictions_by_place(spark, d):
    """Records that died with a session which is still marked active, by place."""
    rows = fated(spark, d).withColumns({"active": F.col("year") >= 1995, "place": F.col("jurisdiction_id")})
    return sessions.contradictions(rows, "status", "active", "place")
