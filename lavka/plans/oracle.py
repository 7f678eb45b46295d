"""The registered queries once more, in plain SQL for DuckDB over the source tables."""

from lavka import fixed, schemas
from lavka.plans.views import duckdb_sql

SALT_PREFIX = "shop:"
HEADER = "order_date, order_pup_date, pp_id, user_name, order_pp_code, status_id"
HEADER_ISO = (
    "strftime(order_date, '%Y-%m-%d') as order_date, "
    "strftime(order_pup_date, '%Y-%m-%d') as order_pup_date, pp_id, user_name, order_pp_code, status_id"
)
PRODUCT_COLUMNS = (
    "product_art, product_name, product_unit, product_price, supp_id, product_manufac, "
    "categ_id, product_discount, product_stock, product_desc, product_photo"
)

# ---- scalar pieces ----------------------------------------------------------


def blank(x):
    return f"nullif(trim({x}), '')"


def default(x, value):
    return f"coalesce({blank(x)}, '{value}')"


def is_number(x):
    pattern = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"coalesce(regexp_full_match(trim({x}), '{pattern}'), false)"


def whole(x):
    return f"case when {is_number(x)} then try_cast(trunc(try_cast(trim({x}) as double)) as int) end"


def money(x):
    return f"case when {is_number(x)} then try_cast(trim({x}) as decimal(10,2)) end"


def unreadable(x, value):
    return f"({blank(x)} is not null and ({value}) is null)"


def date(x):
    return (
        f"coalesce(cast(try_strptime(trim({x}), '%d.%m.%Y') as date), "
        f"cast(try_strptime(trim({x}), '%Y-%m-%d') as date))"
    )


def cells(*columns):
    return "coalesce(" + ", ".join(
        f"case when lower({blank(c)}) <> 'nan' then {blank(c)} end" for c in columns
    ) + ")"


def secret(login, password):
    return f"sha256(concat('{SALT_PREFIX}', trim({login}), ':', trim({password})))"


def lookup(pairs, key, otherwise):
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in pairs.items())
    return f"case {key} {cases} else {otherwise} end"


def quoted(names):
    return ", ".join(f"'{n}'" for n in names)


def role_code(x):
    name = f"lower({default(x, fixed.DEFAULT_ROLE)})"
    return lookup(fixed.ROLE_CODES, name, name)


def role_title(x):
    known = lookup(fixed.ROLE_TITLES, f"lower(trim({x}))", x)
    return f"case when coalesce({x}, '') = '' then '{fixed.ROLE_TITLES['guest']}' else {known} end"


def has_role(x, roles):
    return f"coalesce(lower(trim({x})) in ({quoted(roles)}), false)"


def wrong_number(n):
    return (f"case when {n} is null then 'no_row_no' "
            f"when count(*) over (partition by {n}) > 1 then 'repeated_row_no' end")


def severity(reason, *skipped):
    return f"case when {reason} in ({quoted(skipped)}) then 'skip' else 'abort' end"


# ---- steps as common table expressions --------------------------------------

# Items of an order line in closed form: with l the last non-digit token before
# token i (0 if none), token i is a quantity when it is digits and i - l is odd
# (even for l = 0).
def parsed(name, rows, key, text):
    return f"""
{name}_lists as (
  select {key}, list_filter(list_transform(
      string_split(translate({text}, chr(10) || ';', ',,'), ','), lambda t: trim(t)),
      lambda t: t <> '') as tokens
  from {rows}),
{name}_tokens as (
  select {key}, unnest(tokens) as t, generate_subscripts(tokens, 1) as i from {name}_lists),
{name}_marks as (
  select *, regexp_full_match(replace(t, ' ', ''), '[0-9]+') as digits from {name}_tokens),
{name}_last as (
  select *, coalesce(max(case when not digits then i end) over (
      partition by {key} order by i rows between unbounded preceding and 1 preceding), 0) as l
  from {name}_marks),
{name}_kinds as (
  select *, digits and (i - l) % 2 = (case when l > 0 then 1 else 0 end) as is_qty from {name}_last),
{name}_next as (
  select {key}, i, t, is_qty,
    lead(t) over (partition by {key} order by i) as next_t,
    lead(is_qty) over (partition by {key} order by i) as next_qty
  from {name}_kinds),
{name} as (
  select {key}, cast(row_number() over (partition by {key} order by i) - 1 as int) as pos, t as art,
    case when coalesce(next_qty, false) then try_cast(next_t as int) else 1 end as qty
  from {name}_next where not is_qty)"""


def views_of(*names):
    return ", ".join(f"r_{n} as ({duckdb_sql(n)})" for n in names)


def sql(*parts):
    """CTE texts, then the final select."""
    return "with " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


CATALOG = views_of("products", "categories", "suppliers") + """, catalog as (
  select p.product_id, p.product_art as article, p.product_name, c.categ_name as category_name,
    p.product_desc as description, p.product_manufac as manufacturer_name,
    s.supp_name as supplier_name, p.product_price as price, p.product_unit as unit_name,
    p.product_stock as stock_quantity, p.product_discount as discount, p.product_photo as photo
  from r_products p left join r_categories c on p.categ_id = c.categ_id
    left join r_suppliers s on p.supp_id = s.supp_id)"""

FOUND = "(" + " or ".join(f"{c} ilike '%{{0}}%'" for c in (
    "article", "product_name", "description", "category_name", "manufacturer_name",
    "supplier_name", "unit_name")) + ")"

ARTICLES = """articles as (
  select trim(product_art) as art, min(product_id) as product_id
  from r_products where product_art is not null group by 1)"""

# Exact decimals throughout: a division would turn them into doubles, which are
# off at half cents.
NET = ("cast(round(cast(coalesce({p}, 0) * (100 - greatest(coalesce({d}, 0), 0)) as decimal(18,2)) "
       "* cast(0.01 as decimal(3,2)), 2) as decimal(12,2))")
HIGHLIGHT = ("case when {d} > 15 then 'big_discount' when coalesce({s}, 0) = 0 "
             "then 'out_of_stock' else 'plain' end")

ORDER_NAMES = """
  left join r_statuses st on o.status_id = st.status_id
  left join r_pickup_points pp on o.pp_id = pp.pp_id"""
ORDER_VIEWS = views_of("orders", "order_items", "products", "statuses", "pickup_points")
POSITIONS = """positions as (
  select oi.order_id, oi.product_id, p.product_art as article, oi.product_quantity as quantity,
    row_number() over (partition by oi.order_id order by oi.order_item_id) - 1 as pos
  from r_order_items oi join r_products p on p.product_id = oi.product_id)"""

PART_ROWS = 4096

DOCUMENTS = f"""
select o.order_id as id, coalesce(i.pos // {PART_ROWS}, 0) as part, strftime(o.order_date, '%Y-%m-%d') as order_date,
  strftime(o.order_pup_date, '%Y-%m-%d') as delivery_date, pp.pp_name as pickup_point_address,
  o.order_pp_code as receiver_code, o.user_name as client_name, st.status_name,
  o.pp_id as pickup_point_id, i.pos % {PART_ROWS} as pos, i.product_id, i.article, i.quantity
from r_orders o left join positions i on i.order_id = o.order_id""" + ORDER_NAMES

USERS_TYPED = f"""users_typed as (
  select row_no, {role_code('role')} as user_role, {blank('full_name')} as user_name,
    {blank('login')} as user_login, {secret('login', 'password')} as user_secret,
    {wrong_number('row_no')} as n_bad
  from r_raw_users),
users_clean as (select * exclude (n_bad) from users_typed where user_login is not null and n_bad is null),
users_rejects as (
  select 'users' as source, row_no, coalesce(n_bad, 'blank_login') as reason,
    case when n_bad is null then 'skip' else 'abort' end as severity
  from users_typed where user_login is null or n_bad is not null)"""

PRODUCTS_TYPED = f"""products_typed as (
  select row_no, {blank('article')} as product_art, {blank('product_name')} as product_name,
    {default('unit', fixed.DEFAULT_UNIT)} as product_unit, {blank('supplier')} as supp_name,
    {blank('manufacturer')} as product_manufac, {blank('category')} as categ_name,
    case when {blank('description')} is not null then description end as product_desc,
    {default('photo', fixed.DEFAULT_PHOTO)} as product_photo, {wrong_number('row_no')} as n_bad,
    cast(coalesce({money('price')}, 0) as decimal(10,2)) as product_price,
    coalesce({whole('discount')}, 0) as product_discount,
    coalesce({whole('stock')}, 0) as product_stock,
    {unreadable('price', money('price'))} as p_bad,
    {unreadable('discount', whole('discount'))} as d_bad,
    {unreadable('stock', whole('stock'))} as s_bad
  from r_raw_products),
products_checked as (
  select *, case when n_bad is not null then n_bad
    when product_name is null then 'blank_name' when p_bad then 'bad_price'
    when d_bad then 'bad_discount' when s_bad then 'bad_stock'
    when product_art is null then 'blank_article' when product_price < 0 then 'check_price'
    when product_discount < 0 or product_discount > 100 then 'check_discount' end as reason
  from products_typed),
products_clean as (
  select * exclude (n_bad, p_bad, d_bad, s_bad, reason) from products_checked where reason is null),
products_rejects as (
  select 'products' as source, row_no, reason,
    {severity('reason', 'blank_name', 'blank_article')} as severity
  from products_checked where reason is not null)"""

ORDERS_TYPED = f"""orders_typed as (
  select row_no, {date('order_date')} as order_date, {date('delivery_date')} as order_pup_date,
    {default('client', fixed.NO_VALUE)} as user_name, pickup, {whole('code')} as order_pp_code,
    {blank('status')} as status_name, {cells(*fixed.ORDER_TEXT_COLUMNS)} as order_text,
    product_no, quantity, {unreadable('code', whole('code'))} as c_bad, {wrong_number('row_no')} as n_bad
  from r_raw_orders),
orders_checked as (
  select * exclude (c_bad, n_bad), case when n_bad is not null then n_bad
    when order_date is null then 'bad_order_date' when c_bad then 'bad_pickup_code' end
    as reason from orders_typed)"""

ORDERS_SPLIT = f"""orders_clean as (select * exclude (reason) from orders_checked where reason is null),
orders_rejects as (
  select 'orders' as source, row_no, reason, {severity('reason', 'bad_order_date')} as severity
  from orders_checked where reason is not null)"""

NEW_USERS = """users_first as (
  select * from users_clean qualify row_number() over (partition by user_login order by row_no) = 1),
users_added as (
  select row_no, (select max(user_id) from r_users) + row_number() over (order by row_no) as user_id,
    user_role, user_name, user_login, user_secret
  from users_first
  where user_login not in (select trim(user_login) from r_users where user_login is not null))"""


def dimension(out, table, key, name, rows, cell):
    """``<out>_keys`` (name, key) and ``<out>_created`` (key, name column)."""
    return f"""{out}_known as (
  select trim({name}) as name, min({key}) as {key} from {table} where {name} is not null group by 1),
{out}_wanted as (
  select {blank(cell)} as name, min(row_no) as first_row from {rows}
  where {blank(cell)} is not null group by 1),
{out}_fresh as (
  select coalesce((select max({key}) from {table}), 0)
    + row_number() over (order by first_row nulls last, name) as {key}, name
  from {out}_wanted where name not in (select name from {out}_known)),
{out}_created as (select {key}, name as {name} from {out}_fresh),
{out}_keys as (select name, {key} from {out}_known union all select name, {key} from {out}_fresh)"""


IMPORT_PRODUCTS = ",\n".join([
    PRODUCTS_TYPED,
    dimension("supplier", "r_suppliers", "supp_id", "supp_name", "products_clean", "supp_name"),
    dimension("category", "r_categories", "categ_id", "categ_name", "products_clean", "categ_name"),
    f"""products_added as (
  select row_no, (select max(product_id) from r_products) + row_number() over (order by row_no) as product_id,
    {PRODUCT_COLUMNS}
  from products_clean left join supplier_keys s on s.name = supp_name
    left join category_keys c on c.name = categ_name)""",
])

ADDRESSES = f"""addresses as (
  select row_number() over (order by row_no) as ordinal, {blank('address')} as address
  from r_raw_points where {blank('address')} is not null and lower({blank('address')}) <> 'nan')"""


def located(rows, out="located", addresses="addresses"):
    return f"""{out} as (
  select r.*, case when (select count(*) from {addresses}) > 0 and {is_number('r.pickup')}
      then a.address else {blank('r.pickup')} end as pickup_address
  from {rows} r left join {addresses} a on a.ordinal = {whole('r.pickup')})"""


IMPORT_ORDERS = ",\n".join([
    ORDERS_TYPED,
    ADDRESSES,
    located("orders_checked", "orders_located"),
    f"""orders_addressed as (
  select * replace (case when reason is null and length(pickup_address) > {fixed.MAX_TEXT}
    then 'too_long' else reason end as reason) from orders_located),
located as (select * exclude (reason) from orders_addressed where reason is null),
orders_rejects as (
  select 'orders' as source, row_no, reason, {severity('reason', 'bad_order_date')} as severity
  from orders_addressed where reason is not null)""",
    dimension("point", "r_pickup_points", "pp_id", "pp_name", "located", "pickup_address"),
    dimension("status", "r_statuses", "status_id", "status_name", "located", "status_name"),
    """orders_added as (
  select row_no, (select max(order_id) from r_orders) + row_number() over (order by row_no) as order_id,
    order_date, order_pup_date, pp_id, user_name, order_pp_code, status_id,
    order_text, product_no, quantity
  from located left join point_keys p on p.name = pickup_address
    left join status_keys s on s.name = status_name)""",
    ARTICLES,
    parsed("lines", "(select * from orders_added where order_text is not null)", "row_no", "order_text"),
    """text_items as (
  select l.*, a.product_id, case when qty is null then 'bad_quantity'
    when a.product_id is null then 'unknown_article' when qty < 1 then 'bad_quantity' end as problem
  from lines l left join articles a on a.art = l.art)""",
    f"""number_items as (
  select row_no, 0 as pos, {whole('product_no')} as product_id,
    greatest(coalesce({whole('quantity')}, 1), 1) as qty,
    case when ({whole('product_no')}) is null then 'bad_product_number'
      when {unreadable('quantity', whole('quantity'))} then 'bad_quantity'
      when {whole('product_no')} not in (select product_id from r_products) then 'unknown_product' end
      as problem
  from orders_added where order_text is null and {is_number('product_no')})""",
    """both_items as (
  select row_no, pos, product_id, qty, problem from text_items
  union all select row_no, pos, product_id, qty, problem from number_items),
items_added as (
  select b.row_no, (select max(order_item_id) from r_numbered_items)
      + row_number() over (order by b.row_no, b.pos) as order_item_id,
    o.order_id, b.product_id, b.qty as product_quantity
  from both_items b join orders_added o on o.row_no = b.row_no where b.problem is null),
items_rejects as (
  select 'order_items' as source, row_no, problem as reason,
    case when problem = 'unknown_article' then 'skip' else 'abort' end as severity
  from both_items where problem is not null)""",
])
IMPORT_ORDER_VIEWS = views_of(
    "raw_orders", "raw_points", "orders", "numbered_items", "products", "pickup_points", "statuses"
)

FORM_ITEMS = ",\n".join([
    views_of("order_forms", "products"), ARTICLES,
    parsed("lines", "r_order_forms", "row_no", "product_article"),
    """resolved as (
  select l.*, a.product_id, case when qty is null then 'bad_quantity'
    when a.product_id is null then 'unknown_article' when qty < 1 then 'bad_quantity' end as problem
  from lines l left join articles a on a.art = l.art)""",
])


def product_forms(rows, row_no):
    """``forms_checked``: form rows as product columns, each with its reject reason."""
    return f"""forms_typed as (
  select *, coalesce(trim(article), '') as product_art, {blank('unit')} as product_unit,
    {money('price')} as product_price, {blank('manufacturer')} as product_manufac,
    coalesce({whole('discount')}, 0) as product_discount,
    coalesce({whole('stock_quantity')}, 0) as product_stock,
    description as product_desc, {blank('photo')} as product_photo,
    {unreadable('price', money('price'))} as p_bad,
    {unreadable('discount', whole('discount'))} as d_bad,
    {unreadable('stock_quantity', whole('stock_quantity'))} as s_bad,
    {wrong_number(row_no)} as n_bad
  from {rows}),
supplier_ids as (select supp_name, min(supp_id) as supp_id from r_suppliers group by 1),
category_ids as (select categ_name, min(categ_id) as categ_id from r_categories group by 1),
forms_checked as (
  select f.*, s.supp_id, c.categ_id, case when n_bad is not null then n_bad
    when d_bad then 'bad_discount' when s_bad then 'bad_stock'
    when p_bad then 'bad_price' when product_price < 0 then 'check_price'
    when product_discount < 0 or product_discount > 100 then 'check_discount' end as reason
  from forms_typed f left join supplier_ids s on s.supp_name = {blank('f.supplier')}
    left join category_ids c on c.categ_name = {blank('f.category')}),
forms_rejects as (
  select 'products' as source, {row_no} as row_no, reason, 'abort' as severity
  from forms_checked where reason is not null)"""


INSERT_PRODUCTS = ",\n".join([
    views_of("product_forms", "products", "suppliers", "categories"),
    product_forms("r_product_forms", "row_no"),
    f"""inserted as (
  select row_no, (select max(product_id) from r_products) + row_number() over (order by row_no) as product_id,
    {PRODUCT_COLUMNS} from forms_checked where reason is null)""",
])
UPDATE_PRODUCTS = ",\n".join([
    views_of("product_changes", "products", "suppliers", "categories"),
    product_forms("r_product_changes", "change_no"),
    f"""winners as (
  select product_id, {PRODUCT_COLUMNS} from forms_checked where reason is null
  qualify row_number() over (partition by product_id order by change_no desc) = 1),
updated as (
  select product_id, {PRODUCT_COLUMNS} from r_products
    where product_id not in (select product_id from winners)
  union all
  select product_id, {PRODUCT_COLUMNS} from winners
    where product_id in (select product_id from r_products))""",
])


def order_forms(rows, row_no):
    """``placed``: accepted forms with their keys; ``placed_rejects``; parsed ``lines``."""
    return ",\n".join([
        ARTICLES,
        parsed("lines", rows, row_no, "product_article"),
        f"""verdicts as (
  select l.{row_no}, max(case when qty is null or qty < 1 then 1 else 0 end) as bad_qty,
    max(case when a.product_id is null then 1 else 0 end) as unknown_art
  from lines l left join articles a on a.art = l.art group by 1),
status_ids as (select status_name, min(status_id) as status_id from r_statuses group by 1),
placed_checked as (
  select f.*, f.delivery_date as order_pup_date, f.pickup_point_id as pp_id, s.status_id,
    case when regexp_full_match(trim(f.receiver_code), '[+-]?[0-9]+')
      then try_cast(trim(f.receiver_code) as int) end as order_pp_code,
    case when f.n_bad is not null then f.n_bad when v.{row_no} is null then 'no_items' when v.bad_qty = 1 then 'bad_quantity'
      when coalesce(regexp_full_match(trim(f.receiver_code), '[+-]?[0-9]+'), false)
        and try_cast(trim(f.receiver_code) as int) is null then 'bad_pickup_code'
      when v.unknown_art = 1 then 'unknown_article'
      when f.pickup_point_id not in (select pp_id from r_pickup_points) then 'unknown_pickup_point'
      end as reason
  from (select * exclude (user_name), {blank('user_name')} as user_name,
      {wrong_number(row_no)} as n_bad from {rows}) f
    left join verdicts v on v.{row_no} = f.{row_no}
    left join status_ids s on s.status_name = {blank('f.status_name')}),
placed as (select * from placed_checked where reason is null),
placed_rejects as (
  select 'orders' as source, {row_no} as row_no, reason, 'abort' as severity
  from placed_checked where reason is not null)""",
    ])


ORDER_TABLES = ("orders", "numbered_items", "products", "statuses", "pickup_points")
INSERT_ORDERS = ",\n".join([
    views_of("faulty_forms", *ORDER_TABLES),
    order_forms("r_faulty_forms", "row_no"),
])
INSERT_ITEMS = """items_placed as (
  select {base} + row_number() over (order by l.row_no, l.pos) as order_item_id,
    l.row_no, a.product_id, l.qty as product_quantity
  from lines l join placed p on p.row_no = l.row_no join articles a on a.art = l.art),
headers_placed as (
  select {first} + row_number() over (order by row_no) as order_id, placed.* from placed)"""
INSERT_AFTER = INSERT_ITEMS.format(
    base="(select max(order_item_id) from r_numbered_items)", first="(select max(order_id) from r_orders)"
)
INSERT_EMPTY = INSERT_ITEMS.format(base="0", first="0")

REPLACE_ORDERS = ",\n".join([
    views_of("faulty_changes", *ORDER_TABLES),
    "known_changes as (select * from r_faulty_changes where order_id in (select order_id from r_orders))",
    order_forms("known_changes", "change_no"),
    """last_change as (
  select * from placed qualify row_number() over (partition by order_id order by change_no desc) = 1)""",
])


def audit_rules():
    """One select per rule over the audited tables."""
    tables = {
        "products": "r_audit_products", "orders": "r_audit_orders", "order_items": "r_audit_items",
        "suppliers": "r_suppliers", "categories": "r_categories", "statuses": "r_statuses",
        "pickup_points": "r_pickup_points", "users": "r_audit_users",
    }
    conditions = {
        "products": {
            "price_negative": "product_price < 0",
            "discount_range": "product_discount < 0 or product_discount > 100",
            **{f"{c}_too_long": f"length({c}) > 255" for c in (
                "product_art", "product_name", "product_unit", "product_manufac",
                "product_desc", "product_photo")},
        },
        "orders": {"user_name_too_long": "length(user_name) > 255"},
        "order_items": {"quantity_not_positive": "product_quantity <= 0"},
        "suppliers": {"supp_name_too_long": "length(supp_name) > 255"},
        "categories": {"categ_name_too_long": "length(categ_name) > 255"},
        "statuses": {"status_name_too_long": "length(status_name) > 255"},
        "pickup_points": {"pp_name_too_long": "length(pp_name) > 255"},
        "users": {f"{c}_too_long": f"length({c}) > 255" for c in (
            "user_role", "user_name", "user_login", "user_secret")},
    }
    out = []
    for name, rows in tables.items():
        key = schemas.PRIMARY_KEYS[name]
        out += [
            f"select '{name}' as table_name, '{rule}' as rule, cast({key} as varchar) as row_key, "
            f"1 as violations from {rows} where {condition}"
            for rule, condition in conditions[name].items()
        ]
        out.append(
            f"select '{name}', '{key}_not_unique', cast({key} as varchar), count(*) from {rows} "
            f"group by {key} having {key} is null or count(*) > 1"
        )
    out += [
        f"select '{name}', '{column}_missing', cast({column} as varchar), count(*) from {tables[name]} "
        f"where {column} is not null and {column} not in (select {column} from {tables[other]}) "
        f"group by {column}"
        for name, column, other in schemas.FOREIGN_KEYS
    ]
    return "\nunion all ".join(out)


def summary(people, goods, sales, empty, **counts):
    rejects = " union all ".join(f"select * from {t}" for t in (people, goods, *sales))
    stages = " union all ".join(
        f"select '{stage}', 'imported', '', count(*) from {rows}" for stage, rows in counts.items()
    )
    return f"""
select source as stage, severity as outcome, reason, count(*) as rows from ({rejects}) group by all
union all {stages}
union all select 'orders', 'without_items', '', count(*) from orders_added
  where order_id not in (select order_id from {empty})"""


SUMMARY = summary(
    "users_rejects", "products_rejects", ("orders_rejects", "items_rejects"), "items_added",
    users="users_added", products="products_added", orders="orders_added", order_items="items_added",
    suppliers="supplier_created", categories="category_created",
    pickup_points="point_created", statuses="status_created",
)
ALL_IMPORT_VIEWS = (
    "raw_users", "raw_products", "raw_orders", "raw_points", "users", "products", "suppliers",
    "categories", "orders", "numbered_items", "pickup_points", "statuses",
)

# An empty shop: the same import with tables that hold nothing yet. Products
# of the first stage are what the order items refer to.
FILE_VIEWS = ("raw_users", "raw_products", "raw_orders", "raw_points")
_EMPTY = ("users", "suppliers", "categories", "orders", "numbered_items", "pickup_points", "statuses")


def _no_rows(*names):
    return ", ".join(f"r_{n} as (select * from ({duckdb_sql(n)}) where false)" for n in names)


def empty_shop(*missing):
    """The landing files, some of them missing, and tables without rows."""
    found = [views_of(*[n for n in FILE_VIEWS if n not in missing]), _no_rows(*missing, *_EMPTY)]
    return ", ".join(found) + f", no_products as (select * from ({duckdb_sql('products')}) where false)"


def _in_empty_shop(text):
    for key, table in (
        ("user_id", "r_users"), ("product_id", "no_products"), ("order_id", "r_orders"),
        ("order_item_id", "r_numbered_items"),
    ):
        text = text.replace(f"(select max({key}) from {table})", f"coalesce((select max({key}) from {table}), 0)")
    return text




def import_files(*missing):
    return sql(
        empty_shop(*missing), USERS_TYPED, _in_empty_shop(NEW_USERS),
        _in_empty_shop(IMPORT_PRODUCTS.replace("r_products)", "no_products)")),
        "r_products as (select * from products_added)",
        _in_empty_shop(IMPORT_ORDERS),
        SUMMARY,
    )


# The same import of plain files, up to its tables; descriptions go on in further lines.
STORED_PRODUCTS = ",\n".join([
    empty_shop(),
    """described as (
  select * replace (concat(description, chr(10), '";', product_name, chr(10)) as description) from r_raw_products
  where description is not null and product_name is not null
  union all
  select * replace (cast(null as varchar) as description) from r_raw_products
  where description is null or product_name is null)""",
    _in_empty_shop(IMPORT_PRODUCTS.replace("r_products)", "no_products)").replace("r_raw_products", "described")),
])


def order_list(part_rows):
    return sql(ORDER_VIEWS, POSITIONS, f"""texts as (
  select order_id, pos // {part_rows} as part, string_agg(article || case when quantity > 1
      then ' ×' || cast(quantity as varchar) else '' end, ', ' order by pos) as article
  from positions group by 1, 2)""", """
select o.order_id as id, coalesce(t.part, 0) as part, strftime(o.order_date, '%Y-%m-%d') as order_date,
  strftime(o.order_pup_date, '%Y-%m-%d') as delivery_date, pp.pp_name as pickup_point_address,
  coalesce(t.article, '') as article, st.status_name
from r_orders o left join texts t on t.order_id = o.order_id""" + ORDER_NAMES)


def order_text(part_rows):
    return sql(views_of("order_items", "products"), POSITIONS, f"""
select order_id, pos // {part_rows} as part, string_agg(trim(article) || case when quantity <> 1
    then ', ' || cast(quantity as varchar) else '' end, ', ' order by pos) as order_text
from positions group by 1, 2""")


ORACLE = {
    "order_list": order_list(PART_ROWS),
    "order_list_parts": order_list(3),
    "order_documents": sql(ORDER_VIEWS, POSITIONS, DOCUMENTS),
    "order_lookup": sql(
        ORDER_VIEWS, views_of("order_changes"), POSITIONS,
        DOCUMENTS + " where o.order_id in (select order_id from r_order_changes)",
    ),
    "order_text_format": order_text(PART_ROWS),
    "order_text_parts": order_text(2),
    "order_text_parse": sql(views_of("order_items", "products"), POSITIONS, f"""
select order_id, pos // {PART_ROWS} as part, pos % {PART_ROWS} as pos, trim(article) as art, quantity as qty
from positions"""),
    "order_lines": sql(
        views_of("order_forms"), parsed("lines", "r_order_forms", "row_no", "product_article"),
        "select row_no, pos, art, qty from lines",
    ),
    "order_line_arrays": sql(
        views_of("order_forms"), parsed("lines", "r_order_forms", "row_no", "product_article"), """
select f.row_no, cast(count(l.pos) as int) as items, cast(coalesce(sum(l.qty), 0) as bigint) as pieces
from r_order_forms f left join lines l on l.row_no = f.row_no group by 1"""),
    "catalog_list": sql(CATALOG, "select * from catalog"),
    "catalog_search": sql(CATALOG, "select * from catalog where " + FOUND.format("RED w_dget")),
    "catalog_by_supplier": sql(CATALOG, "select * from catalog where supplier_name = 'Supplier#000000001'"),
    "catalog_stock_asc": sql(CATALOG, "select * from catalog"),
    "catalog_stock_desc": sql(CATALOG, "select * from catalog"),
    "catalog_combined": sql(
        CATALOG, "select * from catalog where supplier_name = 'Supplier#000000001' and " + FOUND.format("ring")
    ),
    "product_lookup": sql(
        CATALOG, "select * from catalog where product_id in (select o_custkey from orders)"
    ),
    "catalog_cards": sql(CATALOG, f"""
select product_id,
  coalesce({blank('category_name')} || ' | ' || {blank('product_name')},
    {blank('product_name')}, {blank('category_name')}, '—') as header,
  {default('description', '—')} as description,
  coalesce(nullif(manufacturer_name, ''), '—') as manufacturer,
  coalesce(nullif(supplier_name, ''), '—') as supplier,
  coalesce(nullif(unit_name, ''), '—') as unit,
  coalesce(stock_quantity, 0) as stock,
  case when discount <> 0 then cast(discount as varchar) || ' %' else '—' end as discount_label,
  cast(coalesce(price, 0) as decimal(12,2)) as price,
  {NET.format(p='price', d='discount')} as net_price,
  coalesce(discount > 0, false) as has_discount,
  case when discount > 0 then 'Цена: ' || cast(cast(price as decimal(12,2)) as varchar) || ' '
      || cast({NET.format(p='price', d='discount')} as varchar) || ' руб.'
    else 'Цена: ' || cast(cast(coalesce(price, 0) as decimal(12,2)) as varchar) || ' руб.' end as price_label,
  {default('photo', fixed.DEFAULT_PHOTO)} as photo,
  {HIGHLIGHT.format(d='discount', s='stock_quantity')} as highlight,
  {lookup(fixed.HIGHLIGHT_COLOURS, '(' + HIGHLIGHT.format(d='discount', s='stock_quantity') + ')', 'null')}
    as colour
from catalog"""),
    "net_prices": sql(views_of("products"), f"""
select product_id, product_price as price, product_discount as discount,
  {NET.format(p='product_price', d='product_discount')} as net_price from r_products"""),
    "highlight_counts": sql(views_of("products"), f"""
select {HIGHLIGHT.format(d='product_discount', s='product_stock')} as highlight, count(*) as products
from r_products group by 1"""),
    "catalog_changes": sql(
        views_of("product_changes", "product_forms", "products", "suppliers", "categories", "order_items"),
        product_forms("r_product_forms", "row_no"),
        product_forms("r_product_changes", "change_no").replace("forms_", "changes_")
        .replace("supplier_ids", "supplier_keys").replace("category_ids", "category_keys"),
        f"""first_forms as (
  select (select max(product_id) from r_products) + row_number() over (order by row_no) as product_id,
    {PRODUCT_COLUMNS} from forms_checked where reason is null and row_no % 2 = 1),
second_forms as (
  select (select max(product_id) from r_products) + (select count(*) from first_forms)
    + row_number() over (order by row_no) as product_id,
    {PRODUCT_COLUMNS} from forms_checked where reason is null and row_no % 2 = 0),
old_rows as (select product_id, {PRODUCT_COLUMNS} from r_products union all select * from first_forms),
winners as (
  select product_id, {PRODUCT_COLUMNS} from changes_checked where reason is null
  qualify row_number() over (partition by product_id order by change_no desc) = 1),
new_rows as (
  select * from (
    select * from old_rows where product_id not in (select product_id from winners)
    union all select * from winners where product_id in (select product_id from old_rows))
  where product_id in (select product_id from r_order_items)
  union all select * from second_forms),
differences as (select o.product_id, concat_ws(',', """ + ", ".join(
            f"case when o.{c} is distinct from n.{c} then '{c}' end" for c in PRODUCT_COLUMNS.split(", ")
        ) + ") as columns from old_rows o join new_rows n on n.product_id = o.product_id)", """
select product_id, 'changed' as change, columns from differences where columns <> ''
union all select product_id, 'removed', '' from old_rows where product_id not in (select product_id from new_rows)
union all select product_id, 'added', '' from new_rows where product_id not in (select product_id from old_rows)"""),
    "supplier_names": sql(views_of("suppliers"), "select supp_name from r_suppliers"),
    "category_names": sql(views_of("categories"), "select categ_name from r_categories"),
    "status_names": sql(views_of("statuses"), "select status_name from r_statuses"),
    "manufacturer_names": sql(views_of("products"), """
select distinct trim(product_manufac) as manufacturer_name from r_products where trim(product_manufac) <> ''"""),
    "pickup_list": sql(views_of("pickup_points"), """
select pp_id as pickup_point_id, pp_name as pickup_address from r_pickup_points"""),
    "clean_users": sql(views_of("raw_users"), USERS_TYPED, "select * from users_clean"),
    "clean_products": sql(views_of("raw_products"), PRODUCTS_TYPED, "select * from products_clean"),
    "clean_orders": sql(views_of("raw_orders"), ORDERS_TYPED, ORDERS_SPLIT, """
select * replace (strftime(order_date, '%Y-%m-%d') as order_date,
  strftime(order_pup_date, '%Y-%m-%d') as order_pup_date) from orders_clean"""),
    "clean_rejects": sql(
        views_of("raw_users", "raw_products", "raw_orders"), USERS_TYPED, PRODUCTS_TYPED, ORDERS_TYPED, ORDERS_SPLIT,
        "select * from users_rejects union all select * from products_rejects "
        "union all select * from orders_rejects",
    ),
    "users_new": sql(views_of("raw_users", "users"), USERS_TYPED, NEW_USERS, "select * from users_added"),
    "dim_get_or_create": sql(
        views_of("raw_products", "suppliers"),
        dimension("supplier", "r_suppliers", "supp_id", "supp_name", "r_raw_products", "supplier"),
        "select * from supplier_keys",
    ),
    "dim_created": sql(
        views_of("raw_products", "categories"),
        dimension("category", "r_categories", "categ_id", "categ_name", "r_raw_products", "category"),
        "select * from category_created",
    ),
    "pickup_resolve": sql(
        views_of("raw_orders", "raw_points"), ADDRESSES, located("r_raw_orders"),
        "select row_no, pickup_address from located",
    ),
    "pickup_without_list": sql(
        views_of("raw_orders"), f"select row_no, {blank('pickup')} as pickup_address from r_raw_orders"
    ),
    "products_imported": sql(
        views_of("raw_products", "products", "suppliers", "categories"), IMPORT_PRODUCTS,
        "select * from products_added",
    ),
    "orders_imported": sql(
        IMPORT_ORDER_VIEWS, IMPORT_ORDERS, f"select row_no, order_id, {HEADER_ISO} from orders_added"
    ),
    "order_items_imported": sql(IMPORT_ORDER_VIEWS, IMPORT_ORDERS, "select * from items_added"),
    "import_rejects": sql(
        IMPORT_ORDER_VIEWS, IMPORT_ORDERS,
        "select * from orders_rejects union all select * from items_rejects",
    ),
    "import_summary": sql(
        views_of(*ALL_IMPORT_VIEWS), USERS_TYPED, NEW_USERS, IMPORT_PRODUCTS, IMPORT_ORDERS, SUMMARY
    ),
    "import_files": import_files(),
    "import_missing_files": import_files("raw_users", "raw_products"),
    "import_stored_users": sql(
        empty_shop(), USERS_TYPED, _in_empty_shop(NEW_USERS),
        "select user_id, user_role, user_name, user_login, user_secret from users_added"),
    "import_stored_products": sql(STORED_PRODUCTS, """
select a.* exclude (row_no, supp_id, categ_id), s.supp_name, c.categ_name
from products_added a left join supplier_created s on s.supp_id = a.supp_id
  left join category_created c on c.categ_id = a.categ_id"""),
    "import_stored_orders": sql(
        STORED_PRODUCTS, "r_products as (select * from products_added)", _in_empty_shop(IMPORT_ORDERS), f"""
select o.order_id, {HEADER_ISO.replace("pp_id, ", "").replace(", status_id", "")}, p.pp_name, s.status_name,
  i.order_item_id, i.product_id, i.product_quantity
from orders_added o left join items_added i on i.order_id = o.order_id
  left join point_created p on p.pp_id = o.pp_id left join status_created s on s.status_id = o.status_id"""),
    "delimited_table": sql(views_of("orders"), """
select order_id, strftime(order_date, '%Y-%m-%d') as order_date, strftime(order_pup_date, '%Y-%m-%d') as order_pup_date,
  concat('"', user_name, '"; said ""', cast(order_pp_code as varchar), '"" ') as note
from r_orders"""),
    "items_strict": sql(FORM_ITEMS, """
select row_no, count(*) as items, min(problem) as problem from resolved group by 1"""),
    "items_lenient": sql(FORM_ITEMS, """
select row_no, pos, product_id, qty from resolved where problem is null"""),
    "items_rejects": sql(FORM_ITEMS, """
select row_no, pos, art, problem from resolved where problem is not null"""),
    "products_inserted": sql(INSERT_PRODUCTS, "select * from inserted"),
    "products_insert_rejects": sql(INSERT_PRODUCTS, "select * from forms_rejects"),
    "products_updated": sql(UPDATE_PRODUCTS, "select * from updated"),
    "products_update_rejects": sql(UPDATE_PRODUCTS, """
select * from forms_rejects
union all select 'products', change_no, 'unknown_product', 'skip' from forms_checked
where reason is null and product_id not in (select product_id from r_products)"""),
    "products_deletable": sql(INSERT_PRODUCTS, views_of("order_items"), """
select product_id from (select product_id from r_products union all select product_id from inserted)
where product_id not in (select product_id from r_order_items)"""),
    "products_blocked": sql(INSERT_PRODUCTS, views_of("order_items"), """
select product_id from (select product_id from r_products union all select product_id from inserted)
where product_id in (select product_id from r_order_items)"""),
    "orders_inserted": sql(
        INSERT_ORDERS, INSERT_AFTER, f"select row_no, order_id, {HEADER_ISO} from headers_placed"
    ),
    "order_items_inserted": sql(INSERT_ORDERS, INSERT_AFTER, """
select i.order_item_id, h.order_id, i.product_id, i.product_quantity
from items_placed i join headers_placed h on h.row_no = i.row_no"""),
    "orders_insert_rejects": sql(INSERT_ORDERS, "select * from placed_rejects"),
    "orders_replaced": sql(REPLACE_ORDERS, f"""
select order_id, {HEADER_ISO} from (
  select order_id, {HEADER} from r_orders where order_id not in (select order_id from last_change)
  union all select order_id, {HEADER} from last_change)"""),
    "order_items_replaced": sql(REPLACE_ORDERS, """
select order_item_id, order_id, product_id, product_quantity from r_numbered_items
where order_id not in (select order_id from last_change)
union all
select (select max(order_item_id) from r_numbered_items)
    + row_number() over (order by l.change_no, l.pos), c.order_id, a.product_id, l.qty
from last_change c join lines l on l.change_no = c.change_no join articles a on a.art = l.art"""),
    "orders_replace_rejects": sql(REPLACE_ORDERS, """
select * from placed_rejects
union all select 'orders', change_no, 'unknown_order', 'abort' from r_faulty_changes
where order_id not in (select order_id from r_orders)"""),
    "orders_deletable": sql(views_of("orders", "order_items"), """
select order_id from r_orders where order_id not in (select order_id from r_order_items)"""),
    "orders_blocked": sql(views_of("orders", "order_items"), """
select order_id from r_orders where order_id in (select order_id from r_order_items)"""),
    "constraint_audit": sql(
        views_of("audit_products", "audit_orders", "audit_items", "suppliers", "categories",
                 "statuses", "pickup_points", "audit_users"),
        audit_rules(),
    ),
    "roles_normalised": sql(
        views_of("raw_users"), f"codes as (select row_no, {role_code('role')} as role_code from r_raw_users)", f"""
select row_no, role_code, {role_title('role_code')} as role_title,
  {has_role('role_code', fixed.ADMIN_ROLES)} as is_admin,
  {has_role('role_code', fixed.MANAGER_ROLES)} as is_manager_or_admin from codes"""),
    "role_capabilities": sql(views_of("users"), f"""
select user_id, user_login as login, {default('user_name', '—')} as full_name, user_role as role_name,
  {role_title('user_role')} as role_title, """ + ", ".join(
        f"{has_role('user_role', roles)} as {name}" for name, roles in (
            ("can_add_product", fixed.ADMIN_ROLES), ("can_edit_product", fixed.ADMIN_ROLES),
            ("can_delete_product", fixed.ADMIN_ROLES), ("can_list_orders", fixed.MANAGER_ROLES),
            ("can_search", fixed.MANAGER_ROLES), ("can_filter_supplier", fixed.MANAGER_ROLES),
            ("can_sort", fixed.MANAGER_ROLES), ("can_add_order", fixed.ADMIN_ROLES),
            ("can_open_order", fixed.ADMIN_ROLES), ("can_delete_order", fixed.ADMIN_ROLES),
        )) + " from r_users"),
    "signin_matches": sql(views_of("attempts", "users"), f"""
select attempt_id, trim(a.login) as login, u.user_id, u.user_name as full_name,
  u.user_role as role_name, u.user_id is not null as matched
from r_attempts a left join r_users u
  on trim(u.user_login) = trim(a.login) and u.user_secret = {secret('a.login', 'a.secret')}"""),
    "stream_order_intake": sql(INSERT_ORDERS, INSERT_EMPTY, f"""
select h.order_id, {HEADER_ISO}, i.order_item_id, i.product_id, i.product_quantity
from headers_placed h join items_placed i on i.row_no = h.row_no"""),
    "stream_first_login": sql(
        views_of("raw_users"), USERS_TYPED, f"r_users as (select * from ({duckdb_sql('users')}) where false)",
        NEW_USERS.replace("(select max(user_id) from r_users)", "0"),
        "select user_id, user_role, user_name, user_login, user_secret from users_added",
    ),
    # Row numbers may repeat here; those of the first wave come first.
    "stream_keyed_logins": sql(views_of("raw_users"), f"""valid as (
  select row_no, coalesce(row_no % 1000 >= 500, true) as later, {role_code('role')} as user_role,
    {blank('full_name')} as user_name, {blank('login')} as user_login, {secret('login', 'password')} as user_secret
  from r_raw_users where row_no is not null and {blank('login')} is not null),
first_rows as (
  select * from valid qualify row_number() over (partition by user_login order by later, row_no) = 1)""", """
select row_number() over (order by later, row_no, user_login) as user_id, user_role, user_name, user_login, user_secret
from first_rows"""),
    "stream_deliveries_once": sql(views_of("order_forms"), "select * from r_order_forms"),
}
# The same results from tables that are stored in another way.
ORACLE |= {name: ORACLE[same] for name, same in {
    "order_list_laid_out": "order_list", "order_list_laid_out_parts": "order_list_parts",
    "order_documents_laid_out": "order_documents", "orders_replaced_laid_out": "orders_replaced",
    "order_items_replaced_laid_out": "order_items_replaced", "orders_blocked_laid_out": "orders_blocked",
    "catalog_changes_by_digest": "catalog_changes", "catalog_search_indexed": "catalog_search",
}.items()}
ORACLE["order_texts_refreshed"] = sql(views_of("order_items", "products"), """after_run as (
  select * replace (case when order_id % 11 = 0 then 2 * product_quantity else product_quantity end as product_quantity)
  from r_order_items where order_id % 7 <> 0)""", POSITIONS.replace("r_order_items", "after_run"), f"""
select order_id, pos // {PART_ROWS} as part, string_agg(article || case when quantity > 1
    then ' ×' || cast(quantity as varchar) else '' end, ', ' order by pos) as article
from positions group by 1, 2""")
