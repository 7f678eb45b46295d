"""Role names, titles and the capabilities a role gives."""

from pyspark.sql import functions as F

from lavka import fixed
from lavka.functions.text import default_if_blank, strip


def _lookup(pairs, key):
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[key]


def _normal(role):
    return F.lower(strip(F.coalesce(role, F.lit(""))))


def role_code(role):
    """Role name of a file -> stored code; unknown names pass in lower case."""
    name = F.lower(default_if_blank(role, fixed.DEFAULT_ROLE))
    return F.coalesce(_lookup(fixed.ROLE_CODES, name), name)


def role_title(role):
    """Stored code -> title; none is a guest, an unknown code stays as it is."""
    title = F.coalesce(_lookup(fixed.ROLE_TITLES, _normal(role)), role)
    empty = F.coalesce(role, F.lit("")) == ""
    return F.when(empty, F.lit(fixed.ROLE_TITLES[fixed.GUEST_ROLE])).otherwise(title)


def is_admin(role):
    return _normal(role).isin(*fixed.ADMIN_ROLES)


def is_manager_or_admin(role):
    return _normal(role).isin(*fixed.MANAGER_ROLES)


def capabilities(role):
    """What a role may do, as named boolean columns."""
    admin, manager = is_admin(role), is_manager_or_admin(role)
    return [
        admin.alias("can_add_product"),
        admin.alias("can_edit_product"),
        admin.alias("can_delete_product"),
        manager.alias("can_list_orders"),
        manager.alias("can_search"),
        manager.alias("can_filter_supplier"),
        manager.alias("can_sort"),
        admin.alias("can_add_order"),
        admin.alias("can_open_order"),
        admin.alias("can_delete_order"),
    ]
