"""The retail tables and their raw inputs, derived from the star-schema tables.

One SQL text per view serves both engines: ``{part}`` and the like are the
source tables, the words in ``ENGINES`` differ per engine. Every view works row
by row or by an aggregate that combines before the shuffle. The arithmetic on
keys spreads blanks, paddings and faulty values over the rows; no row is left
out.
"""

import re

from lavka.operators.sizing import broadcast_if_small

# Source tables with their schemas, so that planning reads no file.
SOURCES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}

ENGINES = {
    "spark": {
        "<S>": "string",
        "<HASH>": "sha2(",
        "</HASH>": ", 256)",
        "<ITEM_KEY>": "struct(l_linenumber, l_partkey, l_quantity, l_suppkey, l_extendedprice)",
    },
    "duckdb": {
        "<S>": "varchar",
        "<HASH>": "sha256(",
        "</HASH>": ")",
        "<ITEM_KEY>": "row(l_linenumber, l_partkey, l_quantity, l_suppkey, l_extendedprice)",
    },
}

SALT = "shop"

# ---- the eight tables -------------------------------------------------------

SUPPLIERS = "select s_suppkey as supp_id, s_name as supp_name from {supplier}"

PICKUP_POINTS = "select cast(n_nationkey as bigint) as pp_id, n_name as pp_name from {nation}"

CATEGORIES = """
select distinct cast(ascii(p_type) * 100 + length(p_type) as bigint) as categ_id,
  p_type as categ_name
from {part}"""

STATUSES = """
select distinct cast(ascii(o_orderstatus) as bigint) as status_id, o_orderstatus as status_name
from {orders}"""

USERS = """
select c_custkey as user_id,
  case c_mktsegment when 'MACHINERY' then 'administrator' when 'BUILDING' then ' Manager'
    when 'HOUSEHOLD' then 'client' when 'FURNITURE' then 'courier' else '' end as user_role,
  case when c_custkey % 12 = 0 then ' ' else c_name end as user_name,
  case when c_custkey % 9 = 0 then concat(' ', c_name) else c_name end as user_login,
  <HASH>concat('shop:', c_name, ':pw', cast(c_custkey % 7 as <S>))</HASH> as user_secret
from {customer}"""

_ARTICLE = """case when p.p_partkey % 7 = 0 then concat('  P', cast(p.p_partkey as <S>), ' ')
       else concat('P', cast(p.p_partkey as <S>)) end"""

# The columns of products that orders need.
PRODUCT_ARTICLES = f"select p.p_partkey as product_id, {_ARTICLE} as product_art from {{part}} p"

# Pads some articles, blanks some manufacturers, leaves some keys out;
# discount 0..30, stock 0..12.
PRODUCTS = f"""
select p.p_partkey as product_id,
  {_ARTICLE} as product_art,
  p.p_name as product_name,
  'шт.' as product_unit,
  cast(p.p_retailprice as decimal(10,2)) as product_price,
  case when p.p_partkey % 20 = 0 then null else l.s end as supp_id,
  case when p.p_partkey % 25 = 0 then ' ' when p.p_partkey % 25 = 1 then null
       else concat(p.p_brand, ' ') end as product_manufac,
  case when p.p_partkey % 30 = 0 then null
       else cast(ascii(p.p_type) * 100 + length(p.p_type) as bigint) end as categ_id,
  p.p_size % 31 as product_discount,
  cast(p.p_partkey % 13 as int) as product_stock,
  concat(p.p_name, ' ', lower(p.p_type)) as product_desc,
  case when p.p_partkey % 2 = 1 then null
       else concat(cast(p.p_partkey as <S>), '.jpg') end as product_photo
from {{part}} p
left join (select l_partkey, min(l_suppkey) as s from {{lineitem}} group by l_partkey) l
  on l.l_partkey = p.p_partkey"""

ORDERS = """
select o.o_orderkey as order_id, cast(o.o_orderdate as date) as order_date,
  cast(l.d as date) as order_pup_date, cast(c.c_nationkey as bigint) as pp_id,
  c.c_name as user_name, cast(o.o_orderkey % 1000 as int) as order_pp_code,
  cast(ascii(o.o_orderstatus) as bigint) as status_id
from {orders} o join {customer} c on c.c_custkey = o.o_custkey
left join (select l_orderkey, max(l_shipdate) as d from {lineitem} group by l_orderkey) l
  on l.l_orderkey = o.o_orderkey"""

# The source has no single item key; the long key orders the items of an order
# without a window over them.
ORDER_ITEMS = """
select <ITEM_KEY> as order_item_id, l_orderkey as order_id, l_partkey as product_id,
  cast(l_quantity as int) as product_quantity
from {lineitem}"""

# With a number as key (repeated for some rows), where new keys are given out.
NUMBERED_ITEMS = """
select l_orderkey * 10 + l_linenumber as order_item_id, l_orderkey as order_id,
  l_partkey as product_id, cast(l_quantity as int) as product_quantity
from {lineitem}"""

# ---- landing rows -----------------------------------------------------------


def faulty_number(key, every):
    """Row numbers of which some are missing and some repeat the one before."""
    return f"case when {key} % {every} = 5 then null when {key} % {every} = 7 then {key} else {key} + 1 end"


# Shared logins compete for the first row; some logins are blank.
RAW_USERS = f"""
select {faulty_number('c_custkey', 97)} as row_no,
  case when c_custkey % 11 = 0 then '  '
       when c_custkey % 4 = 0 then concat(' ', c_mktsegment, '-', cast(c_nationkey as <S>))
       when c_custkey % 4 = 1 then c_name
       else concat('new-', c_name, ' ') end as login,
  case c_mktsegment when 'MACHINERY' then ' Администратор' when 'BUILDING' then 'менеджер'
    when 'HOUSEHOLD' then 'Клиент' when 'FURNITURE' then 'Courier' else ' ' end as role,
  case when c_custkey % 6 = 0 then '' else concat(c_name, ' ') end as full_name,
  concat('pw', cast(c_custkey % 7 as <S>), ' ') as password
from {{customer}}"""

RAW_PRODUCTS = f"""
select {faulty_number('p_partkey', 101)} as row_no,
  case when p_partkey % 37 = 0 then ' ' else concat(' ', p_name) end as product_name,
  case when p_partkey % 3 = 0 then '' else concat(cast(p_partkey as <S>), '.jpg ') end as photo,
  case when p_partkey % 17 = 0 then 'n/a' when p_partkey % 19 = 0 then null
       when p_partkey % 23 = 0 then '-5.50'
       else cast(cast(p_retailprice as decimal(10,2)) as <S>) end as price,
  case when p_size = 50 then '150' when p_size = 49 then '7%' when p_size % 5 = 0
       then concat(cast(p_size as <S>), '.9') when p_size % 5 = 1 then ''
       else cast(p_size as <S>) end as discount,
  case when p_partkey % 41 = 0 then 'many' when p_partkey % 5 = 0 then '12.9'
       when p_partkey % 5 = 1 then null else cast(p_partkey % 13 as <S>) end as stock,
  case when p_partkey % 43 = 0 then '' else concat('N', cast(p_partkey as <S>), ' ') end as article,
  case when p_partkey % 29 = 0 then ' ' when p_size % 4 = 0 then p_brand
       else concat(' Supplier#', lpad(cast(p_size as <S>), 9, '0')) end as supplier,
  case when p_partkey % 31 = 0 then null when p_size % 6 = 0 then concat('New ', p_type, ' ')
       else p_type end as category,
  case when p_partkey % 2 = 0 then concat(p_brand, ' ') else ' ' end as manufacturer,
  case when p_partkey % 9 = 0 then 'пара' else '' end as unit,
  case when p_partkey % 47 = 0 then ' ' when p_partkey % 4 = 0 then concat(' ', lower(p_type), '  ')
       else lower(p_type) end as description
from {{part}}"""

_DATE_TEXT = """concat(lpad(cast(day(o_orderdate) as <S>), 2, '0'), '.',
    lpad(cast(month(o_orderdate) as <S>), 2, '0'), '.', cast(year(o_orderdate) as <S>))"""

# Order lines of every form: several separators, left-out and repeated
# quantities, bare numbers, unknown articles (some of them 0 times), quantities
# that cannot be stored.
_ORDER_LINE = """case o_orderkey % 6
    when 0 then concat('P', cast(o_custkey as <S>), ', 2, P', cast(o_custkey + 1 as <S>), chr(10),
      '5; P', cast(o_custkey + 2 as <S>), ',,', cast(o_custkey % 9 + 1 as <S>), ', 8')
    when 1 then concat(' P', cast(o_custkey as <S>), ' ')
    when 2 then concat('P', cast(o_custkey as <S>), '; X', cast(o_custkey as <S>),
      case when o_orderkey % 4 = 0 then ', 0' else ', 3' end)
    when 3 then concat('P', cast(o_custkey as <S>), ',1 000; P', cast(o_custkey + 3 as <S>))
    when 4 then concat('P', cast(o_custkey as <S>), ';P', cast(o_custkey as <S>), ', 4;;')
    else concat('P', cast(o_custkey as <S>), ', 0, P', cast(o_custkey + 4 as <S>), ', 7') end"""

RAW_ORDERS = f"""
select {faulty_number('o_orderkey', 103)} as row_no,
  case when o_orderkey % 13 = 0 then '30.02.2025'
       when o_orderkey % 13 = 1 then cast(cast(o_orderdate as date) as <S>)
       else {_DATE_TEXT} end as order_date,
  case when o_orderkey % 14 = 0 then 'soon' else {_DATE_TEXT} end as delivery_date,
  case when o_orderkey % 8 = 0 then ' ' else concat(c_name, ' ') end as client,
  case when o_orderkey % 5 = 0 then concat(' ', n_name)
       when o_orderkey % 5 = 1 then concat(cast(n_nationkey as <S>), '.0')
       when o_orderkey % 35 = 2 then concat('Street ', cast(n_nationkey as <S>))
       when o_orderkey % 35 = 3 then '' when o_orderkey % 35 = 4 then '99'
       when o_orderkey % 35 = 9 then repeat(n_name, 60)
       else cast(n_nationkey as <S>) end as pickup,
  case when o_orderkey % 45 = 0 then 'call' when o_orderkey % 45 = 1 then null
       when o_orderkey % 45 = 2 then '901.0' else cast(o_orderkey % 1000 as <S>) end as code,
  case when o_orderkey % 10 = 9 then '' when o_orderkey % 10 = 8 then 'New '
       else o_orderstatus end as status,
  case when o_orderkey % 10 = 0 then null when o_orderkey % 10 in (1, 2) then ' '
       when o_orderkey % 10 = 3 then 'NaN' else line end as order_line,
  case when o_orderkey % 10 = 1 then line else null end as order_article,
  case when o_orderkey % 10 = 2 then line else '' end as order_contents,
  case when o_orderkey % 10 = 3 then line else null end as order_positions,
  case when o_orderkey % 50 = 10 then null when o_orderkey % 50 = 20 then 'none'
       when o_orderkey % 50 = 30 then '-7' when o_orderkey % 50 = 40 then '99999999999' else concat(cast(o_custkey as <S>), '.0') end as product_no,
  case when o_orderkey % 40 = 0 then 'two' when o_orderkey % 40 = 10 then null
       when o_orderkey % 40 = 20 then '0' else '3.7' end as quantity
from (select *, {_ORDER_LINE} as line from {{orders}}) o
  join {{customer}} on c_custkey = o_custkey join {{nation}} on n_nationkey = c_nationkey"""

# Blank lines shift the numbers of the addresses after them.
RAW_POINTS = """
select cast(n_nationkey as bigint) as row_no,
  case when n_nationkey % 9 = 4 then '  ' when n_nationkey % 9 = 7 then 'NaN'
       else concat(' ', n_name) end as address
from {nation}"""

# ---- form input -------------------------------------------------------------

PRODUCT_FORMS = f"""
select {faulty_number('p_partkey', 107)} as row_no,
  case when p_partkey % 6 = 0 then null else concat(' F', cast(p_partkey as <S>), ' ') end as article,
  p_name as product_name,
  case when p_partkey % 4 = 0 then ' ' else 'пара' end as unit,
  case when p_partkey % 16 = 0 then 'free' when p_partkey % 16 = 1 then '-1'
       when p_partkey % 16 = 2 then null
       else cast(cast(p_retailprice as decimal(10,2)) as <S>) end as price,
  concat('Supplier#', lpad(cast(p_size as <S>), 9, '0')) as supplier,
  case when p_partkey % 5 = 0 then '' else p_brand end as manufacturer,
  case when p_partkey % 3 = 0 then lower(p_type) else concat(' ', p_type) end as category,
  case when p_size = 50 then '101' when p_size = 49 then 'all' when p_size % 2 = 0
       then concat(cast(p_size as <S>), '.9') else null end as discount,
  cast(p_partkey % 13 as <S>) as stock_quantity,
  concat(p_type, ' ') as description,
  case when p_partkey % 2 = 0 then ' ' else concat(cast(p_partkey as <S>), '.png') end as photo
from {{part}}"""

# Each order edits the product numbered like its customer; later orders win.
PRODUCT_CHANGES = f"""
select {faulty_number('o_orderkey', 109)} as change_no,
  case when o_orderpriority = '5-LOW' then -1 - o_custkey else o_custkey end as product_id,
  concat('C', cast(o_orderkey as <S>)) as article,
  concat(o_orderpriority, ' ') as product_name,
  'шт.' as unit,
  case when o_orderkey % 7 = 0 then 'free'
       else cast(cast(o_totalprice as decimal(10,2)) as <S>) end as price,
  concat('Supplier#', lpad(cast(o_custkey % 150 as <S>), 9, '0')) as supplier,
  o_orderstatus as manufacturer,
  case when o_orderkey % 2 = 0 then 'ECONOMY' else 'none' end as category,
  cast(o_orderkey % 103 as <S>) as discount,
  case when o_orderkey % 3 = 0 then null else '4.2' end as stock_quantity,
  o_orderpriority as description,
  null as photo
from {{orders}}"""

ORDER_FORMS = f"""
select o_orderkey + 1 as row_no,
  case when o_orderkey % 10 = 0 then ' ;, ' else {_ORDER_LINE} end as product_article,
  case when o_orderkey % 10 = 9 then 'none' else concat(o_orderstatus, ' ') end as status_name,
  case when o_orderkey % 20 = 7 then null when o_orderkey % 20 = 13 then c_nationkey + 1000
       else c_nationkey end as pickup_point_id,
  case when o_orderkey % 9 = 0 then 'call' when o_orderkey % 9 = 1 then null
       when o_orderkey % 99 = 2 then '99999999999' else concat(' ', cast(o_orderkey % 1000 as <S>)) end
    as receiver_code,
  case when o_orderkey % 8 = 0 then ' ' else c_name end as user_name,
  cast(o_orderdate as date) as order_date, cast(null as date) as delivery_date
from {{orders}} join {{customer}} on c_custkey = o_custkey"""

_FORM = "product_article, status_name, pickup_point_id, receiver_code, user_name, order_date, delivery_date"

FAULTY_FORMS = f"""
select {faulty_number('row_no - 1', 89).replace('row_no - 1', '(row_no - 1)')} as row_no, {_FORM}
from ({ORDER_FORMS}) f"""

# Each event edits an order; several edit the same one, later events win.
ORDER_CHANGES = """
select event_id as change_no,
  case when event_type = 'error' then -1 - user_id else user_id * 10 + event_id % 7 end as order_id,
  case when event_type = 'view' then concat('P', cast(user_id as <S>), ', X')
       when event_type = 'click' then concat('P', cast(user_id as <S>), ',', cast(event_id % 5 as <S>))
       else concat('P', cast(user_id as <S>), chr(10), 'P', cast(user_id + 1 as <S>), ', 6') end
    as product_article,
  case when event_type = 'signup' then 'F' else 'none' end as status_name,
  cast(user_id % 25 as bigint) as pickup_point_id,
  cast(event_id % 100 as <S>) as receiver_code,
  event_type as user_name,
  cast(ts as date) as order_date, cast(ts as date) as delivery_date
from {events}"""

FAULTY_CHANGES = f"""
select {faulty_number('change_no', 211)} as change_no, order_id, {_FORM}
from ({ORDER_CHANGES}) f"""

ATTEMPTS = """
select event_id as attempt_id,
  concat('Customer#', lpad(cast(user_id as <S>), 9, '0'), case when event_type = 'view' then ' ' else '' end)
    as login,
  case when event_type = 'error' then 'guess' else concat('pw', cast(user_id % 7 as <S>), ' ') end as secret
from {events}"""

# ---- tables with broken constraints, for the audit --------------------------

AUDIT_PRODUCTS = """
select p_partkey as product_id, concat('P', cast(p_partkey as <S>)) as product_art,
  case when p_partkey % 50 = 0 then repeat(p_name, 40) else p_name end as product_name,
  'шт.' as product_unit,
  cast(p_retailprice - 950 as decimal(10,2)) as product_price,
  case when p_partkey % 20 = 0 then null else p_partkey % 120 end as supp_id,
  p_brand as product_manufac,
  cast(ascii(p_type) * 100 + length(p_type) + p_size % 2 as bigint) as categ_id,
  p_size * 3 - 5 as product_discount, cast(p_partkey % 13 as int) as product_stock,
  p_type as product_desc, cast(null as <S>) as product_photo
from {part}"""

AUDIT_ITEMS = """
select l_orderkey * 10 + l_linenumber as order_item_id,
  case when l_suppkey % 10 = 3 then null when l_suppkey % 10 = 4 then -l_orderkey - 1
       else l_orderkey end as order_id,
  case when l_suppkey % 10 = 5 then -l_partkey - 1 else l_partkey end as product_id,
  cast(l_quantity - 5 as int) as product_quantity
from {lineitem}"""

AUDIT_ORDERS = """
select o_orderkey as order_id, cast(o_orderdate as date) as order_date,
  cast(null as date) as order_pup_date, c_nationkey + 5 as pp_id, c_name as user_name,
  cast(o_orderkey % 1000 as int) as order_pp_code,
  cast(ascii(o_orderstatus) + o_orderkey % 2 as bigint) as status_id
from {orders} join {customer} on c_custkey = o_custkey"""

AUDIT_USERS = """
select case when c_custkey % 60 = 1 then c_custkey - 1 when c_custkey % 60 = 2 then null else c_custkey end as user_id,
  c_mktsegment as user_role,
  case when c_custkey % 70 = 0 then repeat(c_name, 20) else c_name end as user_name,
  case when c_custkey % 80 = 0 then repeat(c_name, 15) else c_name end as user_login,
  <HASH>c_name</HASH> as user_secret
from {customer}"""

VIEWS = {
    "suppliers": SUPPLIERS,
    "pickup_points": PICKUP_POINTS,
    "categories": CATEGORIES,
    "statuses": STATUSES,
    "users": USERS,
    "products": PRODUCTS,
    "product_articles": PRODUCT_ARTICLES,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "numbered_items": NUMBERED_ITEMS,
    "raw_users": RAW_USERS,
    "raw_products": RAW_PRODUCTS,
    "raw_orders": RAW_ORDERS,
    "raw_points": RAW_POINTS,
    "product_forms": PRODUCT_FORMS,
    "product_changes": PRODUCT_CHANGES,
    "order_forms": ORDER_FORMS,
    "order_changes": ORDER_CHANGES,
    "faulty_forms": FAULTY_FORMS,
    "faulty_changes": FAULTY_CHANGES,
    "attempts": ATTEMPTS,
    "audit_products": AUDIT_PRODUCTS,
    "audit_items": AUDIT_ITEMS,
    "audit_orders": AUDIT_ORDERS,
    "audit_users": AUDIT_USERS,
}

# Dimensions computed from large tables.
DERIVED_DIMENSIONS = ("categories", "statuses")


def text_for(engine, name):
    text = VIEWS[name]
    for word, meaning in ENGINES[engine].items():
        text = text.replace(word, meaning)
    return text


def duckdb_sql(name):
    return re.sub(r"\{(\w+)\}", r"\1", text_for("duckdb", name))


def source(spark, sf_dir, table):
    return spark.read.schema(SOURCES[table]).parquet(f"{sf_dir}/{table}.parquet")


def view(spark, sf_dir, name):
    """The named view over the tables in ``sf_dir``."""
    text = text_for("spark", name)
    used = {t: source(spark, sf_dir, t) for t in SOURCES if "{" + t + "}" in text}
    rows = spark.sql(text, **used)
    return broadcast_if_small(rows) if name in DERIVED_DIMENSIONS else rows


def views(spark, sf_dir, *names):
    return [view(spark, sf_dir, name) for name in names]
