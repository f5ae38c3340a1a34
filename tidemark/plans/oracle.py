"""The same results as plain SQL over the raw tables, for the driver's check.

These texts are written from the rules, not from the operators, and share
nothing with them but the shape of the input views.
"""

from __future__ import annotations

import re

_SCHEMA = "concat('s', cast(cast(({0} - {0} % {1}) / {1} as int) as varchar(10)))"
_ORDER_SCHEMA = _SCHEMA.format("o_custkey", 30)
_ORDER_VERSION = "cast((year(o_orderdate) - 1990) * 10000 + month(o_orderdate) as bigint)"
_SCHEMA_NO = "cast(substr(schema_name, 2) as int)"
_DYNAMIC = (
    "'Schema', 'Procedure', 'View', 'TableValuedFunction', 'ScalarFunction', 'DatabaseDdlTrigger', 'DmlTrigger', "
    "'ServerDdlTrigger'"
)

# Named building blocks; `_sql` puts the ones a text mentions in front of it.
_VIEWS = {
    "fx_step": f"""
        select cast(2 * o_orderkey + 2 - d.upgrade as bigint) as id, {_ORDER_SCHEMA} as schema_name
             , o_orderpriority as application_name, {_ORDER_VERSION} as version, d.upgrade as upgrade
             , cast(day(o_orderdate) as int) as sequence
             , concat('step ', cast(o_orderkey as varchar(20))) as description
             , concat('p_', cast(o_orderkey as varchar(20))) as procedure_name
             , case when d.upgrade = 1 and o_orderstatus = 'F' then 1 else 0 end as completed
        from orders cross join (values (1), (0)) as d(upgrade)
        where d.upgrade = 1 or o_orderkey % 7 <> 0""",
    "fx_version": f"""
        select {_ORDER_SCHEMA} as schema_name, o_orderpriority as application_name, max({_ORDER_VERSION}) as version
        from orders where o_orderkey % 40 = 0 group by 1, 2""",
    "fx_target": f"""
        select distinct {_ORDER_SCHEMA} as schema_name, o_orderpriority as application_name
             , case when cast((o_custkey - o_custkey % 30) / 30 as int) % 13 = 0 then null
                    else cast((5 + cast((o_custkey - o_custkey % 30) / 30 as int) % 7) * 10000 + 6 as bigint) end as to_version
        from orders""",
    "fx_request": f"""
        select event_id as request_id, ts, {_SCHEMA.format('user_id', 3)} as schema_name
             , case event_type when 'click' then '1-URGENT' when 'error' then '2-HIGH'
                    when 'purchase' then '3-MEDIUM' when 'signup' then '4-NOT SPECIFIED'
                    else '5-LOW' end as application_name
             , cast((5 + event_id % 7) * 10000 + user_id % 12 as bigint) as to_version
        from events""",
    "fx_version_text": """
        select event_id as id, user_id as a, event_id % 10000 as b, user_id % 7 as c
             , concat(cast(user_id as varchar(20)), '.', cast(event_id % 10000 as varchar(20)), '.', cast(user_id % 7 as varchar(20))) as version_text
        from events""",
    "fx_static_src": """
        select c_custkey, c_name, c_nationkey
             , case when c_custkey % 10 = 5 then 'UPDATED' else c_mktsegment end as c_mktsegment
        from customer where c_custkey % 10 <> 3
        union all
        select c_custkey + 10000000, concat(c_name, '-new'), c_nationkey, c_mktsegment
        from customer where c_custkey % 10 = 7""",
    "fx_element": """
        select p_partkey as element_id, p_type as object_type
             , case when p_size <= 25 then 'UserDefined' else 'Other' end as query_scope
        from part""",
    "fx_relationship": """
        select l_orderkey as from_id, l_partkey as to_id
             , case when l_returnflag = 'R' then 'Composing' when l_returnflag = 'A' then 'Hierarchical'
                    when l_linestatus = 'O' then 'Peer' else 'Unclassified' end as relationship_type
        from lineitem""",
    "fx_plan": """
        select o_orderkey as step_no
             , case when o_orderkey = 0 then 'BeginPreDeploymentScriptStep'
                    when o_orderkey = (select max(o_orderkey) from orders) then 'BeginPostDeploymentScriptStep'
                    when o_orderpriority = '1-URGENT' then 'CreateElementStep'
                    when o_orderpriority = '2-HIGH' then 'AlterElementStep'
                    when o_orderpriority = '3-MEDIUM' then 'DropElementStep'
                    when o_orderpriority = '4-NOT SPECIFIED' then 'SqlPrintStep'
                    else 'SqlRenameStep' end as step_type
             , concat('s', cast(o_custkey % 50 as varchar(10))) as element_schema
             , concat('t', cast(o_orderkey as varchar(20))) as element_name
             , cast(o_custkey % 3 + 1 as int) as batch_count
        from orders""",
    "fx_event_xml": """
        select event_id, ts, user_id
             , case when event_type = 'error' then 'xml_deadlock_report' else event_type end as object_name
        from events""",
    "fx_member": """
        select c.c_custkey as user_id, r.role_name
        from customer c join (values ('reader', 0), ('writer', 1), ('owner', 2)) as r(role_name, min_rank)
          on c.c_custkey % 4 > r.min_rank""",
    "changes": """
        select t.schema_name, t.application_name, coalesce(v.version, 0) as from_version, t.to_version
        from fx_target t left join fx_version v
          on v.schema_name = t.schema_name and v.application_name = t.application_name""",
    "selected": """
        select s.schema_name, s.application_name, s.id as step_id, s.version as step_version
             , s.sequence as step_sequence, s.description as step_description, s.procedure_name as step_procedure
             , cast(c.from_version < c.to_version as int) as is_upgrade_direction
             , cast(c.from_version >= c.to_version as int) as is_downgrade_direction
        from fx_step s join changes c
          on c.schema_name = s.schema_name and c.application_name = s.application_name
        where s.completed = 0
          and ((c.from_version < c.to_version and s.upgrade = 1 and s.version > c.from_version and s.version <= c.to_version)
            or (c.from_version >= c.to_version and s.upgrade = 0 and s.version <= c.from_version and s.version > c.to_version))""",
    "ordered": """
        select *, cast(row_number() over (partition by schema_name, application_name
                 order by case when is_upgrade_direction = 1 then step_version else -step_version end
                        , case when is_upgrade_direction = 1 then step_sequence else -step_sequence end
                        , step_id) as int) as run_order
        from selected""",
    "outcomes": """
        select *, case when coalesce(max(cast(step_id % 97 = 0 as int)) over (
                          partition by schema_name, application_name order by run_order
                          rows between unbounded preceding and 1 preceding), 0) = 1 then 'skipped'
                       when step_id % 97 = 0 then 'failed' else 'run' end as outcome
        from ordered""",
    "summary": """
        select *, case when step_count > 0 then 0 when from_version <> to_version then 2 else 1 end as warning_count
        from (select c.schema_name, c.application_name, c.from_version, c.to_version, count(s.step_id) as step_count
              from changes c left join selected s
                on s.schema_name = c.schema_name and s.application_name = c.application_name
              group by c.schema_name, c.application_name, c.from_version, c.to_version)""",
    "full_plan": f"""
        select step_no, batch_count as batches_if_any
             , case when step_type <> 'SqlRenameStep' then step_type when step_no % 3 = 0 then 'SqlMoveSchemaStep'
                    when step_no % 3 = 1 then 'SqlTableMigrationStep' else step_type end as step_type
             , concat(case when step_no % 9 = 0 then '[srv].[db].' else '' end, '[', element_schema, '].[', element_name, ']') as full_name
             , [{_DYNAMIC}, 'Table', 'Index'][cast(step_no % 10 + 1 as int)] as category
             , element_schema, element_name
             , case when step_no % 4 = 0 then 0 else batch_count end as batch_count
        from fx_plan""",
    "numbered": f"""
        select step_no, first_id + batch_index as batch_id
             , concat(case when step_type in ('CreateElementStep', 'AlterElementStep', 'DropElementStep')
                           then concat(step_type, ' ', full_name) else step_type end, ' batch ', cast(batch_index as varchar)) as description
             , cast(step_type in ('CreateElementStep', 'AlterElementStep', 'DropElementStep') and category in ({_DYNAMIC}) as int) as dynamic
        from (select *, unnest(range(batch_count)) as batch_index
              from (select *, cast(sum(batch_count) over (order by step_no) - batch_count as bigint) as first_id
                    from full_plan
                    where step_no > (select min(step_no) from full_plan where step_type = 'BeginPreDeploymentScriptStep')
                      and step_no < (select min(step_no) from full_plan where step_type = 'BeginPostDeploymentScriptStep')
                      and step_type <> 'SqlPrintStep' and batch_count > 0))""",
    # Requests as moves, then every (request, step) pair the move crosses.
    "moves": """
        select r.*, coalesce(lag(r.to_version) over (partition by r.schema_name, r.application_name order by r.ts, r.request_id)
                           , v.version, 0) as from_version
        from fx_request r left join fx_version v
          on v.schema_name = r.schema_name and v.application_name = r.application_name""",
    "crossed": """
        select m.request_id, m.ts, m.schema_name, m.application_name, m.from_version, m.to_version
             , s.id as step_id, s.version as step_version, s.sequence as step_sequence
             , s.description as step_description, s.procedure_name as step_procedure, s.upgrade
             , row_number() over (partition by s.id order by m.ts, m.request_id) as crossing
             , exists (select 1 from fx_step p where p.schema_name = s.schema_name and p.application_name = s.application_name
                          and p.version = s.version and p.sequence = s.sequence and p.upgrade <> s.upgrade) as has_partner
        from moves m join fx_step s
          on s.schema_name = m.schema_name and s.application_name = m.application_name
         and ((m.from_version < m.to_version and s.upgrade = 1 and s.version > m.from_version and s.version <= m.to_version)
           or (m.from_version >= m.to_version and s.upgrade = 0 and s.version <= m.from_version and s.version > m.to_version))""",
    "executed": "select * from crossed where crossing = 1 or has_partner",
    "report": """
        select case when d.c_custkey is null then 'INSERT' when s.c_custkey is null then 'DELETE' else 'UPDATE' end as action
             , 'customer' as table_name
             , s.c_custkey, d.c_custkey as previous_c_custkey, s.c_name, d.c_name as previous_c_name
             , s.c_nationkey, d.c_nationkey as previous_c_nationkey
             , s.c_mktsegment, d.c_mktsegment as previous_c_mktsegment
        from customer d full outer join fx_static_src s on s.c_custkey = d.c_custkey
        where d.c_custkey is null or s.c_custkey is null or d.c_name is distinct from s.c_name
           or d.c_nationkey is distinct from s.c_nationkey or d.c_mktsegment is distinct from s.c_mktsegment""",
    "grants": """
        select r.role_name, o.object_name, p.privilege
        from (values ('reader'), ('writer'), ('owner')) as r(role_name)
        join (values ('get_step', 'function'), ('get_version', 'function'), ('parse_version', 'open'), ('register_upgrade_step', 'guarded')
                   , ('register_downgrade_step', 'guarded'), ('invoke_step_procedure', 'guarded'), ('set_version', 'guarded')
                   , ('invoke_version_change', 'guarded'), ('add_audit_event', 'guarded')
                   , ('step', 'table'), ('version', 'table'), ('audit_event', 'table')) as o(object_name, kind) on true
        join (values ('SELECT'), ('REFERENCES'), ('EXECUTE'), ('DELETE'), ('INSERT'), ('UPDATE')) as p(privilege)
          on case o.kind when 'function' then p.privilege in ('SELECT', 'REFERENCES')
                  when 'open' then p.privilege = 'EXECUTE'
                  when 'guarded' then p.privilege = 'EXECUTE' and r.role_name <> 'reader'
                  else p.privilege in ('SELECT', 'REFERENCES') or (p.privilege <> 'EXECUTE' and r.role_name <> 'reader') end""",
    "permissions": """
        select distinct m.user_id, g.object_name, g.privilege
        from fx_member m join grants g on g.role_name = m.role_name""",
    "deadlocks": """
        select event_id, ts as event_time, concat('<deadlock><victim>p', cast(user_id as varchar(20)), '</victim></deadlock>') as fragment
        from fx_event_xml where object_name = 'xml_deadlock_report'""",
}


def _sql(body: str) -> str:
    """`body` with the views it needs, each defined before it is used."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, view in _VIEWS.items():
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                visit(view)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as ({_VIEWS[n]})" for n in needed) + "\n" + body


def _batch(upgrade: int, some_schemas: bool) -> str:
    scope = f" and {_SCHEMA_NO} % 3 <> 0" if some_schemas else ""
    own = f"from fx_step where upgrade = {upgrade}{scope}"
    place = "((id - 1) // 2)"
    return f"""
        select schema_name, application_name, version, sequence, concat(description, ' (new text)') as description, procedure_name
        {own} and {place} % 10 <> 3
        union all
        select schema_name, application_name, version, sequence + 100, description, procedure_name
        {own} and {place} % 10 = 7"""


_NO = "cast(substr(schema_name, 2) as int)"
_PROC = "cast(substr(procedure_name, 3) as bigint)"
_REGISTER_BATCH = f"""
    with given as ({_batch(1, True)}), batch as (
      select schema_name, case when {_NO} % 7 = 3 and {_PROC} % 19 = 0 then null else application_name end as application_name
           , case when {_NO} % 7 = 2 and {_PROC} % 13 = 0 then null else version end as version, sequence
           , case when {_NO} % 7 = 1 and {_PROC} % 17 = 0 then repeat(description, 20) else description end as description, procedure_name
      from given
      union all select schema_name, application_name, version, sequence, description, procedure_name from given
      where {_NO} % 7 = 4 and {_PROC} % 23 = 0
    ), known as (
      select distinct schema_name, procedure_name from fx_step where {_NO} % 7 <> 5 or {_PROC} % 29 <> 0
    ), checked as (
      select b.*, k.procedure_name is null as lacking, count(*) over (partition by b.schema_name, b.application_name, b.version
               , b.sequence, b.procedure_name) > 1 and exists (select 1 from fx_step s where s.upgrade = 1 and s.schema_name = b.schema_name
               and s.application_name = b.application_name and s.version = b.version and s.sequence = b.sequence
               and s.procedure_name = b.procedure_name) as doubled
      from batch b left join known k on k.schema_name = b.schema_name and k.procedure_name = b.procedure_name
    ), per_key as (
      select schema_name, application_name
           , case when application_name is null then 'null argument value at @application_name is not expected'
                  when bool_or(lacking) then concat('specified procedure ', min(case when lacking then concat(schema_name, '.', procedure_name) end), ' does not exists in the schema')
                  when bool_or(version is null) then 'null argument value at @step.version is not expected'
                  when max(length(description)) > 128 then 'String or binary data would be truncated in column ''description'' of 128 characters.'
                  when bool_or(doubled) then 'the source holds more than one row for a matched merge key' end as reason
      from checked group by 1, 2
      union all
      select schema_name, application_name, 'null argument value at @step is not expected' from fx_target t
      where not exists (select 1 from batch b where b.schema_name = t.schema_name and b.application_name = t.application_name)
    ), accepted as (
      select b.* from batch b join per_key p on p.reason is null and p.schema_name = b.schema_name and p.application_name = b.application_name
    ), held as (
      select s.schema_name, s.application_name, b.schema_name is not null as here
      from (select * from fx_step where upgrade = 1) s left join accepted b on b.schema_name = s.schema_name and b.application_name = s.application_name
       and b.version = s.version and b.sequence = s.sequence and b.procedure_name = s.procedure_name
    ), acts as (
      select schema_name, application_name, count(*) filter (where here) as updated, count(*) filter (where not here) as deleted, 0 as inserted
      from held group by 1, 2
      union all
      select schema_name, application_name, 0, 0, count(*) from accepted b
      where not exists (select 1 from fx_step s where s.upgrade = 1 and s.schema_name = b.schema_name and s.application_name = b.application_name
        and s.version = b.version and s.sequence = b.sequence and s.procedure_name = b.procedure_name) group by 1, 2
    )
    select p.schema_name, p.application_name, case when reason is null then 'accepted' else 'refused' end as outcome
         , case when reason is not null then concat('Error while registering upgrade step in register_upgrade_step for "', coalesce(p.application_name, '')
                , '" application within [', p.schema_name, '] schema. Error (severity=16): ', reason) end as message
         , cast(case when reason is null then coalesce(sum(a.inserted), 0) else 0 end as bigint) as inserted
         , cast(case when reason is null then coalesce(sum(a.updated), 0) else 0 end as bigint) as updated
         , cast(case when reason is null then coalesce(sum(a.deleted), 0) else 0 end as bigint) as deleted
    from per_key p left join acts a on a.schema_name = p.schema_name and a.application_name = p.application_name
    group by p.schema_name, p.application_name, reason"""


_MERGE = "schema_name, application_name, version, sequence, procedure_name"


def _register(upgrade: int, some_schemas: bool, everywhere: bool) -> str:
    gone = "true" if everywhere else "(schema_name, application_name) in (select (schema_name, application_name) from batch)"
    return _sql(f"""
        select id, schema_name, application_name, version, upgrade, sequence, description, procedure_name, completed from (
          with batch as ({_batch(upgrade, some_schemas)})
          select s.id, s.schema_name, s.application_name, s.version, s.upgrade, s.sequence
               , coalesce(b.description, s.description) as description, s.procedure_name, s.completed
          from (select *, {gone} as in_scope from fx_step) s left join batch b
            on b.schema_name = s.schema_name and b.application_name = s.application_name and b.version = s.version
           and b.sequence = s.sequence and b.procedure_name = s.procedure_name and s.upgrade = {upgrade}
          where s.upgrade <> {upgrade} or b.schema_name is not null or not s.in_scope
          union all
          select (select max(id) from fx_step) + row_number() over (order by {_MERGE}, description)
               , schema_name, application_name, version, {upgrade}, sequence, description, procedure_name, 0
          from batch where not exists (
            select 1 from fx_step s where s.upgrade = {upgrade} and s.schema_name = batch.schema_name
               and s.application_name = batch.application_name and s.version = batch.version
               and s.sequence = batch.sequence and s.procedure_name = batch.procedure_name))""")


def _summarize(scope: str, category: str) -> str:
    own = f"from fx_element where query_scope = '{scope}'"
    return f"""
        select '{category}' as category, object_type as "key", count(*) as value {own} group by object_type
        union all select '{category}', 'subtotal', count(*) {own}
        union all select '{category}', 'total items', count(distinct object_type) {own}"""


_RELATIONSHIPS = """
    select 'Relationships' as category, b.name as "key"
         , (select count(*) from fx_relationship where relationship_type = b.name) as value
    from (values ('Composing'), ('Hierarchical'), ('Peer')) as b(name)
    union all select 'Relationships', 'subtotal', count(*) from fx_relationship"""

_POSITION = "concat(application_name, '(', cast(step_version as varchar), ')+', cast(step_sequence as varchar))"
_BASE = f"concat('step_id=', cast(step_id as varchar), ', ', {_POSITION}, ' via ', schema_name, '.[', step_procedure, ']()')"
_MOVE = "cast(from_version as varchar), '{0}', cast(to_version as varchar)"
_FAILED_KEYS = "(schema_name, application_name) in (select (schema_name, application_name) from outcomes where outcome = 'failed')"

_TRACE = f"""
    select schema_name, application_name, position, "from", message from (
      select schema_name, application_name, unnest([1, 2]) as position, 'invoke_version_change' as "from"
           , unnest([repeat('=', 117), concat('BEGIN: Change version from ', {_MOVE.format(' to ')}, ' via ', cast(step_count as varchar), ' steps.')]) as message
      from summary where to_version is not null
      union all
      select schema_name, application_name, 3, 'invoke_version_change'
           , concat('WARN: There are no change(s) detected between ', {_MOVE.format(' and ')})
      from summary where to_version is not null and warning_count >= 1
      union all
      select schema_name, application_name, 4, 'invoke_version_change'
           , concat('WARN: There are no change steps registered between ', {_MOVE.format(' and ')})
      from summary where to_version is not null and warning_count = 2
      union all
      select schema_name, application_name, 4 * run_order - 1, 'invoke_version_change'
           , concat('START: (Upgrade=', cast(is_upgrade_direction as varchar), '/Downgrade=', cast(is_downgrade_direction as varchar)
                  , ') step for ', {_POSITION}, ' via "', step_description, '".')
      from outcomes where outcome <> 'skipped'
      union all
      select schema_name, application_name, 4 * run_order, 'invoke_step_procedure', concat('EXEC: ', {_BASE})
      from outcomes where outcome <> 'skipped'
      union all
      select schema_name, application_name, 4 * run_order + 1, 'invoke_step_procedure'
           , case outcome when 'failed' then concat('ERROR: step failed(Severity=16) from ', {_BASE})
                  else concat('SUCCESS: step_id=', cast(step_id as varchar), ' completed = 1.') end
      from outcomes where outcome <> 'skipped'
      union all
      select schema_name, application_name, 4 * run_order + 2, 'invoke_version_change', concat('FINISH: step procedure for ', {_POSITION})
      from outcomes where outcome = 'run'
      union all
      select schema_name, application_name, 2 + warning_count + 4 * step_count + unnest([1, 2, 3])
           , unnest(['set_version', 'invoke_version_change', 'invoke_version_change'])
           , unnest([concat('INFO: Setting "', schema_name, '" schema''s version to "', cast(to_version as varchar), '" registered by application "', application_name, '".')
                   , concat('CEASE: Change version from ', {_MOVE.format(' to ')}), repeat('=', 117)])
      from summary where to_version is not null and not {_FAILED_KEYS})"""

_RUNS = f"""
    select {_SCHEMA_NO} as session_id, schema_name, application_name, from_version, to_version
         , step_count as planned_steps, steps_run, cast(warning_count as bigint) as warnings
         , timestamp '2020-01-01 00:00:00' + to_seconds(2) as started
         , timestamp '2020-01-01 00:00:00' + to_seconds(case when stopped is null then 4 + warning_count + 4 * step_count else 4 * stopped + 1 end) as ended
         , case when stopped is null then 'completed' else 'failed' end as outcome
    from (select s.*, (select min(run_order) from outcomes o where o.schema_name = s.schema_name
                          and o.application_name = s.application_name and o.outcome = 'failed') as stopped
               , (select count(*) from outcomes o where o.schema_name = s.schema_name
                          and o.application_name = s.application_name and o.outcome = 'run') as steps_run
          from summary s where to_version is not null)"""


def _publish_part(slot: str, steps: str, versions: str, text: str) -> str:
    """One part of a publish as chained views `<slot>_...`."""
    key = "schema_name = {0}.schema_name and application_name = {0}.application_name"
    return f"""
      {slot}_change as (
        select k.*, coalesce((select version from {versions} v where v.{key.format('k').replace(' and ', ' and v.')}), 0) as from_version
        from (select schema_name, application_name, {text} as to_version from fx_target) k where to_version is not null),
      {slot}_ordered as (
        select s.*, row_number() over (partition by s.schema_name, s.application_name
                 order by case when s.upgrade = 1 then s.version else -s.version end
                        , case when s.upgrade = 1 then s.sequence else -s.sequence end, s.id) as run_order
        from {steps} s join {slot}_change c using (schema_name, application_name)
        where s.completed = 0 and s.upgrade = cast(c.from_version < c.to_version as int)
          and s.version > least(c.from_version, c.to_version) and s.version <= greatest(c.from_version, c.to_version)),
      {slot}_stop as (
        select schema_name, application_name, min(run_order) as stop from {slot}_ordered where id % 97 = 0 group by 1, 2),
      {slot}_done as (
        select o.* from {slot}_ordered o left join {slot}_stop f using (schema_name, application_name)
        where f.stop is null or o.run_order < f.stop),
      {slot}_steps as (
        select s.* exclude (completed)
             , case when s.id in (select id from {slot}_done) then 1
                    when exists (select 1 from {slot}_done d where d.schema_name = s.schema_name and d.application_name = s.application_name
                           and d.version = s.version and d.sequence = s.sequence and d.upgrade <> s.upgrade) then 0
                    else s.completed end as completed
        from {steps} s),
      {slot}_versions as (
        select schema_name, application_name, coalesce(c.to_version, v.version) as version
        from {versions} v full outer join (select * from {slot}_change anti join {slot}_stop using (schema_name, application_name)) c
          using (schema_name, application_name))"""


_DOWN_TEXT = f"case when {_SCHEMA_NO} % 13 = 0 then null else (3 + {_SCHEMA_NO} % 3) * 10000 + 1 end"
_UP_TEXT = f"case when {_SCHEMA_NO} % 17 = 0 then null else (7 + {_SCHEMA_NO} % 3) * 10000 + 9 end"

_DEPLOY = f"""
    with fx_step as ({_VIEWS['fx_step']}), fx_version as ({_VIEWS['fx_version']}), fx_target as ({_VIEWS['fx_target']}),
    {_publish_part('down', 'fx_step', 'fx_version', _DOWN_TEXT)},
    {_publish_part('up', 'down_steps', 'down_versions', _UP_TEXT)}
    select s.schema_name, s.application_name, coalesce(max(v.version), 0) as version
         , cast(sum(s.upgrade * s.completed) as bigint) as completed_up
         , cast(sum((1 - s.upgrade) * s.completed) as bigint) as completed_down
    from up_steps s left join up_versions v using (schema_name, application_name) group by 1, 2"""

_CHECKED_TEXT = """
    select id, a, b, c, case id % 11 when 0 then null when 1 then '1..2' when 2 then '1.x.3' when 3 then ' 7 .+2.-1'
           when 4 then '1e3.1' when 5 then '1234567890123456789.1' when 6 then '1.10000' else version_text end as text
    from fx_version_text"""


def _phases(transactional: bool) -> str:
    """The publish order written out for a plan with both markers and no bracket of its own."""
    rows = [
        ("5", 1, 2, "DeploySchemaVersionStep", "downgrade"),
        ("post", -1, 1, "DeployStaticDataModelStep", "static data"),
        ("post", -1, 2, "DeploySchemaVersionStep", "upgrade"),
    ]
    if transactional:
        rows.append(("5", 1, 1, "CustomSqlBeginTransactionStep", "begin"))
        rows.append(("post", -1, 3, "CustomSqlEndTransactionStep", "end"))
    post = "(select max(o_orderkey) from orders)"
    added = "\n".join(
        f"union all select {post if place == 'post' else place}, {side}, {rank}, '{kind}', '{phase}', null"
        for place, side, rank, kind, phase in rows
    )
    return _sql(f"""
        select cast(row_number() over (order by place, side, rnk) as bigint) as final_order, phase, step_type, step_no from (
          select step_no as place, 0 as side, 0 as rnk
               , case when step_no = 5 then 'EndPreDeploymentScriptStep' else step_type end as step_type
               , case when step_no <= 5 then 'pre-deployment' when step_no = {post} then 'post-deployment' else 'body' end as phase
               , step_no
          from fx_plan
          {added})""")


_PLAN_REPORT = """
    select step_no, step_type
         , case when step_type in ('SqlTableMigrationStep', 'CreateElementStep', 'AlterElementStep', 'DropElementStep') then full_name end as name
         , case when step_type in ('SqlRenameStep', 'SqlMoveSchemaStep', 'SqlTableMigrationStep', 'CreateElementStep', 'AlterElementStep', 'DropElementStep')
                then category end as category
         , case when step_type in ('SqlRenameStep', 'SqlMoveSchemaStep') then element_name end as original_name
         , case when step_type = 'SqlRenameStep' then concat(element_name, '_new') end as new_name
         , case when step_type = 'SqlMoveSchemaStep' then concat(element_schema, '_new') end as new_schema
         , {0} as script
    from full_plan"""

_EXECUTED = """
    select request_id, ts, schema_name, application_name, from_version, to_version, step_id, step_version, step_sequence
         , step_description, step_procedure, upgrade
    from executed"""

# One request of every key after the other; each round carries all flags on to the next.
_ANY_FLAGS = """
    select * from (
      with recursive turns as (
        select *, row_number() over (partition by schema_name, application_name order by ts, request_id) as k
        from fx_request where to_version is not null
      ), moves as (
        select t.*, coalesce(lag(t.to_version) over (partition by t.schema_name, t.application_name order by t.k), v.version, 0) as from_version
        from turns t left join fx_version v on v.schema_name = t.schema_name and v.application_name = t.application_name
      ), state as (
        select s.id, s.schema_name, s.application_name, s.version, s.sequence, s.upgrade, s.completed, cast(0 as bigint) as k, false as ran
        from fx_step s
        where exists (select 1 from moves m where m.schema_name = s.schema_name and m.application_name = s.application_name)
        union all
        select id, schema_name, application_name, version, sequence, upgrade
             , case when ran then 1 when partner then 0 else completed end, k, ran
        from (
          select *, max(ran) over (partition by schema_name, application_name, version, sequence) and not ran
             and upgrade <> direction as partner
          from (
            select s.id, s.schema_name, s.application_name, s.version, s.sequence, s.upgrade, s.completed, m.k
                 , case when m.from_version < m.to_version then 1 else 0 end as direction
                 , s.completed = 0 and s.upgrade = case when m.from_version < m.to_version then 1 else 0 end
                   and s.version > least(m.from_version, m.to_version) and s.version <= greatest(m.from_version, m.to_version) as ran
            from state s join moves m on m.schema_name = s.schema_name and m.application_name = s.application_name and m.k = s.k + 1) r) p
      )
      select m.request_id, m.ts, s.schema_name, s.application_name, m.from_version, m.to_version, s.id as step_id, s.version as step_version
           , s.sequence as step_sequence, f.description as step_description, f.procedure_name as step_procedure, s.upgrade
      from state s join moves m on m.schema_name = s.schema_name and m.application_name = s.application_name and m.k = s.k
      join fx_step f on f.id = s.id
      where s.ran) q"""

ORACLES: dict[str, str] = {
    "split_items": """
        select p_partkey, cast(unnest(range(1, len(l) + 1)) as int) as item_number, unnest(l) as item
        from (select p_partkey, string_split(p_name, ' ') as l from part)""",
    "split_items_documents": """
        select doc_id, cast(unnest(range(1, len(l) + 1)) as int) as item_number, unnest(l) as item
        from (select doc_id, string_split(text, chr(10)) as l from documents)""",
    "parse_version": _sql("""
        select id, version_text, cast(a * 100000000 + b * 10000 + c as bigint) as version from fx_version_text"""),
    "parse_version_base1000": _sql("""
        select id, version_text, cast(a * 1000000 + b * 1000 + c as bigint) as version from fx_version_text"""),
    "parse_version_checked": _sql(f"""
        select id, text as version_text
             , cast(case when id % 11 in (0, 1, 2, 4, 5) then null when id % 11 = 3 then 700019999 when id % 11 = 6 then 20000
                    else a * 100000000 + b * 10000 + c end as bigint) as version
             , case when id % 11 in (0, 1, 2, 4, 5) then concat('Error while parsing version text "', coalesce(text, '')
                  , '". Error (severity=16): ', case when text is null then 'null argument value at @version_text is not expected'
                        when id % 11 = 5 then 'Arithmetic overflow error converting varchar to data type numeric.'
                        else 'Error converting data type varchar to numeric.' end) end as error
             , case when id % 11 = 6 then 'item of 1.10000 reaches the weight base 10000' end as warning
        from ({_CHECKED_TEXT})"""),
    "get_version": _sql("""
        select t.schema_name, t.application_name, coalesce(v.version, 0) as version
        from fx_target t left join fx_version v on v.schema_name = t.schema_name and v.application_name = t.application_name"""),
    "set_version": _sql("""
        select coalesce(t.schema_name, v.schema_name) as schema_name, coalesce(t.application_name, v.application_name) as application_name
             , coalesce(t.to_version, v.version) as version
        from fx_version v full outer join (select * from fx_target where to_version is not null) t
          on v.schema_name = t.schema_name and v.application_name = t.application_name"""),
    "missing_procedures": _sql(f"""
        select id, schema_name, application_name, procedure_name from fx_step s
        where not exists (select 1 from orders o where o.o_orderkey % 11 <> 0
          and {_SCHEMA.format('o.o_custkey', 30)} = s.schema_name and concat('p_', cast(o.o_orderkey as varchar)) = s.procedure_name)"""),
    "register_upgrade_steps": _register(1, True, False),
    "register_batch": _sql(f"select * from ({_REGISTER_BATCH}) q"),
    "register_downgrade_steps": _register(0, True, False),
    "register_upgrade_steps_all_keys": _register(1, True, True),
    "register_steps_report": _sql(f"""
        select action, id, schema_name, application_name, version, sequence, procedure_name from (
          with batch as ({_batch(1, False)}), own as (select * from fx_step where upgrade = 1)
          select case when b.schema_name is null then 'DELETE' else 'UPDATE' end as action, s.id
               , s.schema_name, s.application_name, s.version, s.sequence, s.procedure_name
          from own s left join batch b using (schema_name, application_name, version, sequence, procedure_name)
          where b.schema_name is not null or (s.schema_name, s.application_name) in (select (schema_name, application_name) from batch)
          union all
          select 'INSERT', (select max(id) from fx_step) + row_number() over (order by {_MERGE}, description)
               , schema_name, application_name, version, sequence, procedure_name
          from batch anti join own using (schema_name, application_name, version, sequence, procedure_name))"""),
    "merge_source_duplicates": """
        select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2
        having count(*) > 1 and count_if(l_returnflag = 'R') > 0""",
    "assign_identity": """
        select c_custkey, c_name, cast((select max(s_suppkey) from supplier) + row_number() over (order by c_name desc, c_custkey) as bigint) as id
        from customer""",
    "fill_defaults": _sql("""
        select id, schema_name, application_name, version, sequence, description, procedure_name, 1 as upgrade, 0 as completed from fx_step"""),
    "change_direction": _sql("""
        select *, cast(coalesce(from_version < to_version, false) as int) as is_upgrade_direction
             , cast(coalesce(from_version >= to_version, false) as int) as is_downgrade_direction from changes"""),
    "get_steps": _sql("select * from selected"),
    "order_steps": _sql("select * from ordered"),
    "change_summary": _sql("select * from summary"),
    "apply_change": _sql("""
        select s.* exclude (completed)
             , case when s.id in (select step_id from selected) then 1
                    when exists (select 1 from selected d where d.schema_name = s.schema_name and d.application_name = s.application_name
                           and d.step_version = s.version and d.step_sequence = s.sequence and d.is_upgrade_direction <> s.upgrade) then 0
                    else s.completed end as completed
        from fx_step s"""),
    "cut_after_failure": _sql("select schema_name, application_name, step_id, run_order, outcome from outcomes"),
    "advance_version": _sql(f"""
        select coalesce(c.schema_name, v.schema_name) as schema_name, coalesce(c.application_name, v.application_name) as application_name
             , coalesce(c.to_version, v.version) as version
        from fx_version v full outer join (select * from changes where to_version is not null and not {_FAILED_KEYS}) c
          on c.schema_name = v.schema_name and c.application_name = v.application_name"""),
    "replay_changes": _sql(_EXECUTED),
    "replay_changes_any_flags": _sql(_ANY_FLAGS),
    "stream_version_changes": _sql(_EXECUTED),
    "replay_final_state": _sql("""
        select s.id, s.upgrade
             , cast(case when last_own is null then 0 when last_other is null or last_own > last_other then 1 else 0 end as int) as completed
        from fx_step s
        left join (select step_id, max((ts, request_id)) as last_own from executed group by 1) o on o.step_id = s.id
        left join (select schema_name, application_name, step_version, step_sequence, upgrade, max((ts, request_id)) as last_other
                   from executed group by 1, 2, 3, 4, 5) p
          on p.schema_name = s.schema_name and p.application_name = s.application_name and p.step_version = s.version
         and p.step_sequence = s.sequence and p.upgrade <> s.upgrade"""),
    "replay_final_versions": _sql("""
        select coalesce(r.schema_name, v.schema_name) as schema_name, coalesce(r.application_name, v.application_name) as application_name
             , coalesce(r.to_version, v.version) as version
        from fx_version v full outer join (
          select schema_name, application_name, arg_max(to_version, (ts, request_id)) as to_version from fx_request group by 1, 2) r
          on r.schema_name = v.schema_name and r.application_name = v.application_name"""),
    "deploy_run": _DEPLOY,
    "reconcile": _sql("select * from fx_static_src"),
    "change_report": _sql("select * from report"),
    "change_report_reference_deletes": _sql("""
        select action, table_name
             , c_custkey, case when action <> 'DELETE' then previous_c_custkey end as previous_c_custkey
             , c_name, case when action <> 'DELETE' then previous_c_name end as previous_c_name
             , c_nationkey, case when action <> 'DELETE' then previous_c_nationkey end as previous_c_nationkey
             , c_mktsegment, case when action <> 'DELETE' then previous_c_mktsegment end as previous_c_mktsegment
        from report"""),
    "reconcile_natural_key": _sql("""
        select coalesce(d.c_custkey, s.c_custkey + 500000) as c_custkey, s.c_name, s.c_nationkey, s.c_mktsegment
        from fx_static_src s left join customer d on d.c_name = s.c_name"""),
    "reconcile_many": _sql("""
        select *, cast(null as bigint) as s_suppkey, cast(null as bigint) as previous_s_suppkey, cast(null as varchar) as s_name
             , cast(null as varchar) as previous_s_name, cast(null as int) as s_nationkey, cast(null as int) as previous_s_nationkey
             , 1 as unit_no from report
        union all by name
        select case when s_suppkey % 10 = 3 then 'DELETE' else 'UPDATE' end as action, 'supplier' as table_name
             , case when s_suppkey % 10 = 5 then s_suppkey end as s_suppkey, s_suppkey as previous_s_suppkey
             , case when s_suppkey % 10 = 5 then s_name end as s_name, s_name as previous_s_name
             , cast(null as int) as s_nationkey, s_nationkey as previous_s_nationkey, 2 as unit_no
        from supplier where s_suppkey % 10 in (3, 5)"""),
    "reconcile_unit_files": _sql("""
        select * from (with second as (
            select s_name, s_suppkey, s_nationkey, s_suppkey % 10 = 3 as gone from supplier where s_suppkey % 10 = 3
               or (s_suppkey % 10 = 5 and s_nationkey is not null))
           , third as (
            select cast(c_custkey as varchar) as row_key, c_mktsegment, c_custkey % 10 = 1 as gone from fx_static_src
            where c_custkey % 10 = 1 or (c_custkey % 10 = 7 and c_mktsegment is distinct from 'THIRD'))
           , first as (
            select action, cast(coalesce(c_custkey, previous_c_custkey) as varchar) as row_key, unnest([
                     {'c': 'c_custkey', 'v': cast(c_custkey as varchar), 'p': cast(previous_c_custkey as varchar)},
                     {'c': 'c_name', 'v': c_name, 'p': previous_c_name},
                     {'c': 'c_nationkey', 'v': cast(c_nationkey as varchar), 'p': cast(previous_c_nationkey as varchar)},
                     {'c': 'c_mktsegment', 'v': c_mktsegment, 'p': previous_c_mktsegment}]) as x
            from report)
           , later as (
            select 2 as unit_no, '020+supplier.DATA.sql' as file_name, 'supplier' as table_name, s_name as row_key, gone, unnest([
                     {'c': 's_suppkey', 'v': cast(s_suppkey as varchar), 'p': cast(s_suppkey as varchar)},
                     {'c': 's_name', 'v': s_name, 'p': s_name},
                     {'c': 's_nationkey', 'v': cast(null as varchar), 'p': cast(s_nationkey as varchar)}]) as x
            from second
            union all
            select 3, '030_segments.data.sql', 'customer', row_key, gone, unnest([
                     {'c': 'c_custkey', 'v': row_key, 'p': row_key}, {'c': 'c_mktsegment', 'v': 'THIRD', 'p': c_mktsegment}])
            from third)
        select 1 as unit_no, '010 customer.data.sql' as file_name, action, 'customer' as table_name, row_key
             , x.c as column_name, x.v as value, x.p as previous_value
        from first
        union all
        select unit_no, file_name, case when gone then 'DELETE' else 'UPDATE' end, table_name, row_key
             , x.c, case when not gone then x.v end, x.p
        from later)"""),
    "reconcile_buckets": _sql("""
        select *, 1 as pass from report
        union all by name
        select 'UPDATE' as action, 'customer' as table_name, c_custkey, c_custkey as previous_c_custkey, c_name, c_name as previous_c_name
             , c_nationkey, c_nationkey as previous_c_nationkey, 'FEW' as c_mktsegment, c_mktsegment as previous_c_mktsegment, 2 as pass
        from fx_static_src where c_custkey % 997 = 5 and c_mktsegment is distinct from 'FEW'"""),
    "bundle_round_trip": """
        select doc_id as position, concat(lang, '-', cast(doc_id as varchar), '.data.sql') as file_name, text as content from documents""",
    "append_audit": """
        select cast(row_number() over (order by event_type, message) - 1 as bigint) as id, 7 as session_id, event_type as "from", message
        from (select event_type, concat('event ', cast(event_id as varchar), ' ', props) as message from events)""",
    "audit_trace": _sql(_TRACE),
    "audit_runs": _sql(_RUNS),
    "summarize_user_defined": _sql(_summarize("UserDefined", "UserDefinedElements")),
    "summarize_other": _sql(_summarize("Other", "OtherElements")),
    "summarize_ranked": _sql(f"""
        select category, "key", value, cast(row_number() over (
                 order by case "key" when 'subtotal' then 1 when 'total items' then 2 else 0 end, value, "key") as bigint) as position
        from ({_summarize("UserDefined", "UserDefinedElements")})"""),
    "summarize_named": _sql(f"""
        select category, "key", value, cast(row_number() over (
                 order by case "key" when 'subtotal' then 1 when 'total items' then 2 else 0 end, "key") as bigint) as position
        from ({_summarize("UserDefined", "UserDefinedElements")})"""),
    "survey_relationships": _sql(_RELATIONSHIPS),
    "model_info": """
        select 'Basic model info' as category, 'Version' as "key", 'Sql130' as value
        union all select 'Basic model info', 'Collation', concat('1033, ', arg_min(p_brand, p_partkey)) from part having count(*) > 0""",
    "statistics_report": _sql(f"""
        select category, "key", value
             , concat(lpad("key", cast(max(length("key")) over (partition by category) + 2 as int), ' '), ': ', cast(value as varchar)) as line
             , replace(category, ' ', '') as xml_category, replace("key", ' ', '_') as xml_key
        from ({_summarize("UserDefined", "UserDefinedElements")} union all {_summarize("Other", "Other Elements")}
              union all {_RELATIONSHIPS})"""),
    "plan_report_summary": _sql(_PLAN_REPORT.format("cast(null as varchar)")),
    "plan_report_details": _sql(_PLAN_REPORT.format("case when step_no % 4 <> 0 then concat('batch of ', element_name) end")),
    "qualified_name": _sql("select step_no, full_name as name from full_plan"),
    "number_batches": _sql("select * from numbered"),
    "total_batches": _sql("select count(*) as total_batch_count from numbered"),
    "pending_batches": _sql("select * from numbered where batch_id % 3 <> 0"),
    "record_batches": _sql("select batch_id, description from numbered where batch_id % 3 = 0 or batch_id % 2 = 0"),
    "steps_of_type": _sql("select * from fx_plan where step_type = 'DropElementStep'"),
    "first_last_of_type": _sql("""
        select t.step_type, min(p.step_no) as first_step_no, max(p.step_no) as last_step_no, cast(count(p.step_no) > 0 as int) as has_type
        from (values ('CreateElementStep'), ('AlterElementStep'), ('SqlRenameStep'), ('SqlBeginTransactionStep')) as t(step_type)
        left join fx_plan p on p.step_type = t.step_type group by 1"""),
    "plan_phases": _phases(True),
    "plan_phases_plain": _phases(False),
    "unique_violations": """
        select l_orderkey, l_linenumber, count(*) as occurrences from lineitem group by 1, 2 having count(*) > 1""",
    "foreign_key_violations": """
        select o_orderkey, o_custkey from orders where o_custkey is not null
          and not exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 10 <> 3)""",
    "delete_guard": "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_custkey % 10 = 3)",
    "column_violations": """
        select 'p_name' as column_name, 'not_null' as rule, count_if(p_name is null) as violations from part
        union all select 'p_name', 'max_length(12)', count_if(length(p_name) > 12) from part
        union all select 'p_type', 'not_null', count_if(p_type is null) from part
        union all select 'p_brand', 'max_length(7)', count_if(length(p_brand) > 7) from part""",
    "column_violations_documents": """
        select 'text' as column_name, 'not_null' as rule, count_if(text is null) as violations from documents
        union all select 'text', 'max_length(2048)', count_if(length(text) > 2048) from documents
        union all select 'lang', 'max_length(2)', count_if(length(lang) > 2) from documents""",
    "effective_permissions": _sql("select * from permissions"),
    "check_permission": _sql("""
        select a.user_id, a.object_name, a.privilege, cast(p.user_id is not null as int) as allowed
             , case when p.user_id is null then concat('permission was denied on the object ''', a.object_name, '''') end as message
        from (select c_custkey as user_id
                   , case c_custkey % 3 when 0 then 'invoke_version_change' when 1 then 'step' else 'get_version' end as object_name
                   , case c_custkey % 3 when 0 then 'EXECUTE' when 1 then 'UPDATE' else 'SELECT' end as privilege from customer) a
        left join permissions p on p.user_id = a.user_id and p.object_name = a.object_name and p.privilege = a.privilege"""),
    "extract_events": _sql("select event_id, fragment, event_time from deadlocks"),
    "event_file_names": _sql("""
        select event_id, concat('localdb-Projects-deadlock-', stamp, case when copy = 1 then '' else concat('-', cast(copy as varchar)) end, '.xdl') as file_name
        from (select *, row_number() over (partition by stamp order by event_id) as copy
              from (select *, strftime(event_time, '%Y%m%d-%H%M%S') as stamp from deadlocks))"""),
    "export_events": _sql("""
        select concat('localdb-Projects-deadlock-', stamp, case when copy = 1 then '' else concat('-', cast(copy as varchar)) end, '.xdl') as file_name
             , fragment
        from (select *, row_number() over (partition by stamp order by event_id) as copy
              from (select *, strftime(event_time, '%Y%m%d-%H%M%S') as stamp from deadlocks))"""),
    "event_file_names_literal_clock": _sql("""
        select event_id, concat('localdb-Projects-deadlock-', strftime(event_time, '%Y%m%d-%I%M%S'), '.xdl') as file_name from deadlocks"""),
    "event_file_names_with_id": _sql("""
        select event_id, concat('localdb-Projects-deadlock-', coalesce(strftime(event_time, '%Y%m%d-%H%M%S'), 'untimed'), '-',
                                cast(event_id as varchar), '.xdl') as file_name from deadlocks"""),
    "stream_audit": """select distinct event_id, ts as "when", event_type as message from events""",
}
