"""Projections of the driver tables onto the record shapes the operators read.

Each text runs unchanged on Spark and on DuckDB, except where a Spark form is given besides.
"""

DUCK: dict[str, str] = {}
SPARK: dict[str, tuple[str, list[str]]] = {}


def _both(name: str, source: str, text: str, spark: str | None = None) -> None:
    DUCK[name] = text
    SPARK[name] = (spark or text, [source])


_both(
    "metrics",
    "events",
    """
    select event_id as point_id, 'app.' || event_type as name, cast(user_id % 10 as string) as tag_user,
           'app.' || event_type || ':user=' || cast(user_id % 10 as string) as series_key, ts, value from events
    """,
)

_both(
    "counters",
    "events",
    """
    select event_id as point_id, event_type as label, ts, event_id % 500 as counter_value from events
    """,
)

_both(
    "histogram",
    "events",
    """
    select label, le, sum(case when value <= le then 1 else 0 end) as cum_count
    from (select event_type as label, value, unnest([1, 5, 10, 50, 100, 500]) as le from events) group by label, le
    """,
    spark="""
    select label, le, sum(case when value <= le then 1 else 0 end) as cum_count
    from (select event_type as label, value, explode(array(1, 5, 10, 50, 100, 500)) as le from events) group by label, le
    """,
)

# Statements of the query log, so that every rule, pattern and word of the audit meets some that match and some that don't.
SQL_STATEMENTS = (
    "'SELECT * FROM orders'",
    "'SELECT o_orderkey FROM orders WHERE o_orderkey = # ORDER BY 1'",  # the event's number
    "'INSERT INTO users (name) VALUES (''test'')'",
    "'UPDATE users SET name = ''test'' WHERE id = 1'",
    "'DELETE FROM users'",
    "'DELETE FROM users WHERE id = 1'",
    "'DROP TABLE users'",
    "'EXEC xp_cmdshell ''dir'''",
    "'SELECT name FROM sys.objects -- comment'",
    "'select /* hint */ a.id, count(*) from a join b on a.id = b.id group by a.id limit 5'",
    "'UPDATE users SET name = 1'",
    "'BULK INSERT users FROM file1'",
    "'SELECT a FROM OPENROWSET(1, 2)'",
    "'SELECT a FROM OPENDATASOURCE(1, 2) WHERE b = 3'",
    "'LOAD DATA INFILE f INTO TABLE t'",
    "'RESTORE DATABASE main FROM disk1'",
    "'BACKUP DATABASE main TO disk1'",
    "'EXEC (@statement)'",
    "'EXECUTE(@statement)'",
    "'EXEC sp_executesql @statement'",
    "'EXEC sp_configure ''show advanced options'', 1'",
    "'SELECT IS_MEMBER(''db_owner''), ''db_securityadmin'', ''db_ddladmin'', ''sysadmin'''",
    "'GRANT SELECT ON orders TO someone'",
    "'REVOKE SELECT ON orders FROM someone'",
    "'DENY SELECT ON orders TO someone'",
    "'CALL orders_insert_row(1)'",
    "'call report(1)'",
    "'SELECT remove (a) FROM t'",
    "'SHUTDOWN WITH NOWAIT'",
    "'KILL 53'",
    "'CREATE TABLE t (a int)'",
    "'CREATE TRIGGER g ON t AFTER INSERT AS SELECT 1'",
    "'CREATE PROCEDURE p AS SELECT 1'",
    "'ALTER TABLE t MODIFY a bigint'",
    "'ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0)'",
    "'TRUNCATE TABLE t CASCADE'",
    "'DROP INDEX i ON t'",
    "'MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN UPDATE SET b = s.b'",
    "'REPLACE INTO t VALUES (1)'",
    "'SELECT a FROM t UNION SELECT b FROM s'",
    "'SELECT a FROM information_schema.tables JOIN master.dbo.b ON 1 = 1 JOIN model.dbo.c ON 1 = 1 JOIN msdb.dbo.d ON 1 = 1 JOIN tempdb.dbo.e ON 1 = 1 JOIN f ON 1 = 1'",
    "'SELECT a FROM mysql.user JOIN performance_schema.b ON 1 = 1 JOIN pg_catalog.c ON 1 = 1 JOIN pg_toast.d ON 1 = 1'",
    "'WAITFOR DELAY 1'",
    "'selection(1)'",
    "'db.users.find({})'",
    "'SELECT a, ''' || repeat('long text ', 40) || ''' FROM t ORDER BY a LIMIT 3'",
)
DOCUMENT_STATEMENTS = (
    "'db.users.find({}).limit(10)'",
    "'db.users.deleteMany({})'",
    "'db.users.find({})'",
    "'db.users.findOne({})'",
    "'db.users.aggregate([])'",
    "'db.users.count({})'",
    "'db.users.distinct(1)'",
    "'db.users.insertOne({a: 1})'",
    "'db.users.insertMany([{a: 1}])'",
    "'db.users.updateOne({}, {$set: {a: 1}})'",
    "'db.users.updateMany({}, {$unset: {a: 1}})'",
    "'db.users.deleteOne({a: 1})'",
    "'db.users.deleteMany({$where: 1})'",
    "'db.users.replaceOne({}, {a: 1})'",
    "'db.users.createIndex({a: 1})'",
    "'db.users.dropIndex(1)'",
    "'db.users.drop()'",
    "'db.dropDatabase()'",
    "'db.createCollection(1)'",
    "'db.users.bulkWrite([{a: {$push: {b: 1}}}])'",
    "'db.users.findAndModify({remove: true}) + db.carts.remove({$pull: 1, $inc: 2})'",
    "'{''find'': ''users''}'",
    "'{update: 1, delete: 2, insert: 3}'",
    "'SELECT * FROM users'",
)
_SHAPES = len(SQL_STATEMENTS) + len(DOCUMENT_STATEMENTS)
_LISTED = ", ".join((*SQL_STATEMENTS, *DOCUMENT_STATEMENTS))


def _query_log(statement: str) -> str:
    return f"""
    select event_id, ts, 's' || cast(user_id as string) as session_id,
           case when user_id % 3 = 0 then 'prod_main' when user_id % 3 = 1 then 'dev_main' else 'sandbox_main' end as database_name,
           case when event_id % {_SHAPES} >= {len(SQL_STATEMENTS)} then case when user_id % 2 = 0 then 'mongodb' else 'MongoDB' end
                when user_id % 3 = 2 then 'local_sandbox' else 'mssql' end as database_type,
           replace({statement}, '#', cast(event_id as string)) as query,
           event_type <> 'error' as success, value / 100 as execution_time from events
    """


_both(
    "query_log",
    "events",
    _query_log(f"([{_LISTED}])[event_id % {_SHAPES} + 1]"),
    spark=_query_log(f"element_at(array({_LISTED}), cast(event_id % {_SHAPES} + 1 as int))"),
)

_both(
    "audit",
    "events",
    """
    select event_id, ts, 's' || cast(user_id as string) as session_id,
           case event_type when 'signup' then 'CONNECTION' when 'purchase' then 'DISCONNECTION' when 'error' then 'BLOCKED'
                when 'view' then 'SUSPICIOUS' else 'QUERY' end as type,
           case event_type when 'error' then 'DENIED' when 'view' then 'REVIEW' when 'signup' then 'ESTABLISHED'
                when 'purchase' then 'CLOSED' else 'ALLOWED' end as status from events
    """,
)

_both(
    "connections",
    "events",
    """
    select event_id, ts, '10.' || cast(user_id % 4 as string) || '.' || cast(event_id % 256 as string) || '.7' as source_ip from events
    """,
)

_both(
    "health",
    "events",
    """
    select event_id, ts, 'svc' || cast(user_id % 5 as string) as service, case when event_type = 'error' then 0 else 1 end as value from events
    """,
)

_both(
    "costs",
    "orders",
    """
    select o_orderkey as cost_id, o_orderdate as ts,
           case o_orderstatus when 'F' then 'aws' when 'O' then 'azure' else 'fabric' end as provider,
           o_orderpriority as service, 'USD' as currency, o_totalprice / 1000 as cost from orders
    """,
)

_both(
    "resources",
    "part",
    """
    select 'aws:' || case when p_partkey % 3 = 0 then 'ec2' when p_partkey % 3 = 1 then 's3' else 'rds' end || ':' || cast(p_partkey as string) as identifier,
           case p_partkey % 2 when 0 then 'aws' else 'fabric' end as provider,
           case when p_partkey % 3 = 0 then 'compute' when p_partkey % 3 = 1 then 'storage' else 'database' end as resource_type,
           case when p_partkey % 7 = 0 then 'unhealthy' else 'healthy' end as status,
           p_name as name, case when p_partkey % 5 = 0 then null else p_retailprice / 1000 end as cost_per_hour,
           case when p_partkey % 4 = 0 then null else p_partkey % 101 end as cpu_utilization, p_size * 4 as last_access_days from part
    """,
)

_both(
    "people",
    "customer",
    """
    select c_custkey as person_id, 'user' || cast(c_custkey as string) || '@mail.test' as contact_email, c_name as first_name,
           '555-' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '-' || lpad(cast(c_custkey % 10000 as string), 4, '0') as phone,
           lpad(cast(c_custkey % 1000 as string), 3, '0') || '-45-6789' as ssn,
           '4532-1234-5678-' || lpad(cast(c_custkey % 10000 as string), 4, '0') as credit_card,
           case when c_custkey % 11 = 0 then null else c_acctbal end as salary,
           '192.168.' || cast(c_custkey % 256 as string) || '.1' as ip_address, c_mktsegment as non_sensitive from customer
    """,
)

_both(
    "grants",
    "customer",
    """
    select c_custkey as grant_id, 'p' || cast(c_custkey % 50 as string) as principal, 'r' || cast(c_nationkey as string) as resource,
           case when c_custkey % 2 = 0 then 'read' else 'read,write' end as permissions,
           case when c_custkey % 3 = 0 then timestamp '2001-01-01 00:00:00' else null end as expires_at,
           case when c_custkey % 5 = 0 then 'true' else null end as require_mfa from customer
    """,
)

_both(
    "requests",
    "orders",
    """
    select o_orderkey as request_id, 'p' || cast(o_custkey % 60 as string) as principal, 'r' || cast(o_orderkey % 30 as string) as resource,
           case when o_orderkey % 2 = 0 then 'write' else 'read' end as permission,
           case when o_orderkey % 4 = 0 then 'false' else 'true' end as mfa from orders
    """,
)

_both(
    "subjects",
    "customer",
    """
    select c_custkey as subject_id, c_custkey % 20 as password_length, c_custkey % 2 = 0 as mfa_enabled, c_custkey % 3 = 0 as encrypted_at_rest,
           c_custkey % 4 = 0 as public_access, c_custkey % 5 <> 0 as encryption_in_transit,
           case when c_custkey % 6 = 0 then '443,23' else '443,22' end as allowed_ports from customer
    """,
)

_both(
    "incidents",
    "orders",
    """
    select o_orderkey as incident_id, o_orderdate as ts,
           case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' else 'medium' end as threat_level,
           case o_orderstatus when 'F' then 'resolved' when 'O' then 'open' else 'in_progress' end as remediation_status from orders
    """,
)

_both(
    "keys",
    "supplier",
    """
    select s_suppkey as key_id, case when s_suppkey % 4 = 0 then 'deprecated' else 'active' end as status,
           timestamp '2001-05-01 00:00:00' + interval 1 day * s_suppkey as created_at, 90 as rotation_days from supplier
    """,
)

_both(
    "sandboxes",
    "customer",
    """
    select c_custkey as sandbox_id, case c_custkey % 4 when 0 then 'sqlite' when 1 then 'postgres' when 2 then 'mysql' else 'mongodb' end as sandbox_type,
           case c_custkey % 5 when 0 then 'failed' when 1 then 'paused' else 'active' end as state,
           timestamp '2001-08-15 00:00:00' + interval 1 hour * (c_custkey % 400) as created_at,
           case when c_custkey % 3 = 0 then null else timestamp '2001-08-30 00:00:00' + interval 1 hour * (c_custkey % 48) end as last_refreshed,
           c_custkey % 2 = 0 as auto_refresh, 24 as refresh_hours, c_custkey % 3 <> 1 as auto_cleanup, 7 as max_age_days,
           c_custkey % 6 as error_count, c_acctbal as storage_mb, case when c_custkey % 2 = 0 then 'etl,team1' else 'ml' end as tags from customer
    """,
)

_both(
    "sessions",
    "events",
    """
    select event_id as session_id, user_id, ts as created_at, ts + interval 1 hour as expires_at,
           case when event_type = 'error' then 'terminated' else 'active' end as status from events
    """,
)

_both(
    "tasks",
    "orders",
    """
    select o_orderkey as task_id, case when o_orderkey < 2 then null else floor(o_orderkey / 2) end as dependency,
           case o_orderkey % 3 when 0 then 'data_analyst' when 1 then 'code_generator' else 'test_runner' end as agent_type,
           case when o_orderstatus = 'F' then 'completed' when o_orderstatus <> 'O' then 'failed' when o_orderkey % 5 = 0 then 'running' else 'pending' end as status,
           o_orderdate as started_at, case when o_orderstatus = 'O' then null else o_orderdate + interval 1 minute * (o_orderkey % 500) end as completed_at from orders
    """,
)

_both(
    "sync_target",
    "customer",
    """
    select c_custkey, c_name, c_nationkey, case when c_custkey % 9 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal,
           case when c_custkey % 13 = 0 then null else c_mktsegment end as c_mktsegment from customer where c_nationkey <> 7
    """,
)

_both(
    "columns",
    "part",
    """
    select p_partkey as column_id, 'db' || cast(floor(p_partkey / 8) % 3 as int) as database_name,
           'tbl' || cast(floor(p_partkey / 8) as int) as table_name, cast(p_partkey % 8 as int) as ordinal,
           case cast(p_partkey % 16 as int)
             when 0 then 'email' when 1 then 'contact_email' when 2 then 'contact_email_address' when 3 then 'first_name'
             when 4 then 'last_name' when 5 then 'phone' when 6 then 'telephone_mobile_cell' when 7 then 'ssn'
             when 8 then 'salary' when 9 then 'credit_card' when 10 then 'password_pwd_secret' when 11 then 'ip_address'
             when 12 then 'non_sensitive' when 13 then 'zip_code' when 14 then 'l_orderkey' else 'user_name' end as column_name,
           case cast(p_partkey % 16 as int) when 8 then 'decimal' when 10 then 'text' when 13 then 'int'
             when 14 then 'bigint' else 'varchar' end as data_type,
           p_size % 2 = 0 as nullable from part
    """,
)
