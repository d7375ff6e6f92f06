"""The derived inputs of ``fixtures.py`` as SQL common table expressions.

Used only by the DuckDB oracle: every oracle query is ``WITH <these> <body>``
over the base tables the checker registers. Double literals carry an
exponent so that both engines type them as DOUBLE.
"""

from geodemand.functions.geo import round_to_sql

FX_CTES = """
fx_sites AS (
 select s_suppkey as site_id, s_name as name, s_nationkey as state, s_acctbal as value,
  35.0e0 + (s_suppkey*7919 % 1000)/100.0e0 as lat, -85.0e0 + (s_suppkey*6151 % 1000)/100.0e0 as lon from supplier),
fx_places AS (
 select c_custkey as place_id, c_name as name, case when c_custkey % 10 = 0
   then concat(' ', upper(concat('Supplier#', lpad(cast(c_custkey // 10 as varchar), 9, '0'))), ' ')
   else concat('Customer#', lpad(cast(c_custkey - c_custkey % 3 as varchar), 9, '0')) end as town, c_nationkey as state, cast(floor(greatest(c_acctbal, 0.0e0)*100) as bigint) as pop,
  35.0e0 + ((c_custkey+17)*3571 % 9973)/1000.0e0 as lat, -85.0e0 + ((c_custkey+17)*7907 % 9967)/1000.0e0 as lon from customer),
fx_obs AS (
 select c.c_custkey as obs_id, s.site_id as true_site, c.c_acctbal as value,
  case when c.c_custkey % 11 = 0 then (s.state + 1) % 25 else s.state end as state,
  case when c.c_custkey % 3 = 0
       then concat('#', right(s.name, 9), ' Supplier (Lot ', cast(c.c_custkey as varchar(20)), '), XX')
       else concat(s.name, ' Station, XX') end as raw_name,
  s.lat + ((c.c_custkey*37 % 101)-50)/400.0e0 as lat, s.lon + ((c.c_custkey*53 % 103)-51)/400.0e0 as lon
 from (select cu.*, n.n_sites from customer cu cross join (select count(*) as n_sites from supplier) n) c
 join fx_sites s on s.site_id = c.c_custkey % c.n_sites),
fx_obs_gaps AS (
 select obs_id, raw_name, value, case when obs_id % 19 = 0 then null else state end as state,
  case when obs_id % 17 = 0 then null else lat end as lat, case when obs_id % 17 = 0 then null else lon end as lon from fx_obs),
fx_facilities AS (
 select site_id as facility_id, lat, lon, cast(site_id % 4 as int) as rail_code, cast((site_id*7 + 1) % 4 as int) as bus_code,
  cast(state % 4 as int) as air_code, cast(site_id % 3 as int) as class_code from fx_sites),
fx_trips AS (
 select o_orderkey as trip_id, o_custkey // 3 as route_id, o_orderpriority as service_id,
  cast(o_orderkey % 2 as int) as direction_id, o_orderstatus as kind from orders),
fx_calendar AS (
 select * from (values ('1-URGENT',1,1,1,1,1,1,1),('2-HIGH',1,1,1,1,1,0,0),
  ('3-MEDIUM',0,0,0,0,0,1,1),('4-NOT SPECIFIED',1,0,1,0,1,0,0))
  as t(service_id, mon, tue, wed, thu, fri, sat, sun)),
fx_stop_times AS (
 select trip_id, stop_id, stop_sequence,
  concat(lpad(cast(6 + stop_sequence*3 as varchar(10)),2,'0'), ':', lpad(cast(stop_id*7 % 60 as varchar(10)),2,'0'), ':00') as arrival_time,
  concat(lpad(cast(6 + stop_sequence*3 as varchar(10)),2,'0'), ':', lpad(cast(stop_id*7 % 60 as varchar(10)),2,'0'), ':',
         lpad(cast(qty as varchar(10)),2,'0')) as departure_time
 from (select l_orderkey as trip_id, l_suppkey as stop_id, cast(floor(l_quantity) as int) as qty,
   cast(row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey,
     l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) as int) as stop_sequence from lineitem) x),
fx_stops AS (
 select site_id as stop_id, name as stop_name, lat as stop_lat, lon as stop_lon from fx_sites),
fx_area_stats AS (
 select lpad(cast(n_nationkey as varchar(10)),5,'0') as area_fips,
  case when n_nationkey % 7 = 0 then '-' else cast(1000 + n_nationkey*13 as varchar(10)) end as total_raw,
  case when n_nationkey % 5 = 0 then 'N' else cast(100 + n_nationkey*3 as varchar(10)) end as part_raw,
  case when n_nationkey % 6 = 0 then '250,000+' else cast(50000 + n_nationkey*1000 as varchar(10)) end as income_raw from nation),
fx_model AS (
 select c.c_custkey as id, c.c_name as name, cast(c.c_nationkey as double) as nation, c.c_acctbal as balance,
  c.c_mktsegment as segment, cast(p.n_orders as double) as n_orders, p.avg_price, cast(p.n_finished as double) as n_finished,
  pl.lat, pl.lon, cast(pl.pop as double) as pop, p.spend, ln(1.0e0 + p.spend) as y
 from customer c
 join (select o_custkey, count(*) as n_orders, sum(o_totalprice) as spend, avg(o_totalprice) as avg_price,
         sum(case when o_orderstatus = 'F' then 1 else 0 end) as n_finished from orders group by o_custkey) p
   on c.c_custkey = p.o_custkey
 join fx_places pl on pl.place_id = c.c_custkey)
"""


def with_fx(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    """Prefix a query body with the fixture CTEs (and optional extra CTEs, comma-led)."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + FX_CTES.strip() + (",\n" + extra_ctes.strip() if extra_ctes.strip() else "") + "\n" + body


def r6(expr: str) -> str:
    """6-decimal rounding, twin of ``functions.geo.round6``."""
    return round_to_sql(expr, 6)
