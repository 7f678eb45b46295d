"""Fixed values.

They are part of the data contract (file headers, role names, labels), so they
are stated as they are and used by every module that needs them.
"""

# Column headers of the landing files -> column names used in this package.
USER_HEADERS = {
    "Логин": "login",
    "Роль сотрудника": "role",
    "ФИО": "full_name",
    "Пароль": "password",
}
PRODUCT_HEADERS = {
    "Наименование товара": "product_name",
    "Фото": "photo",
    "Цена": "price",
    "Действующая скидка": "discount",
    "Кол-во на складе": "stock",
    "Артикул": "article",
    "Поставщик": "supplier",
    "Категория товара": "category",
    "Производитель": "manufacturer",
    "Единица измерения": "unit",
    "Описание товара": "description",
}
ORDER_HEADERS = {
    "Дата заказа": "order_date",
    "Дата доставки": "delivery_date",
    "ФИО авторизированного клиента": "client",
    "Адрес пункта выдачи": "pickup",
    "Код для получения": "code",
    "Статус заказа": "status",
    "Строка заказа": "order_line",
    "Артикул заказа": "order_article",
    "Состав заказа": "order_contents",
    "Позиции": "order_positions",
    "Номер товара": "product_no",
    "Количество": "quantity",
}
# Headers without which an order file is refused.
ORDER_REQUIRED = ("order_date", "delivery_date", "pickup")
# Spellings of the item text column, in order of preference.
ORDER_TEXT_COLUMNS = ("order_line", "order_article", "order_contents", "order_positions")

# Defaults for blank cells.
DEFAULT_UNIT = "шт."
DEFAULT_PHOTO = "picture.png"
DEFAULT_ROLE = "клиент"
NO_VALUE = "—"

# Roles: name in the files -> stored code, and stored code -> title.
ROLE_CODES = {
    "администратор": "administrator",
    "менеджер": "manager",
    "клиент": "client",
}
ROLE_TITLES = {
    "admin": "Администратор",
    "administrator": "Администратор",
    "manager": "Менеджер",
    "client": "Клиент",
    "guest": "Гость",
}
ADMIN_ROLES = ("administrator", "admin")
MANAGER_ROLES = ("manager", "administrator", "admin")
GUEST_ROLE = "guest"

# Card highlighting: a discount above this percentage wins over empty stock.
BIG_DISCOUNT = 15
HIGHLIGHT_COLOURS = {
    "big_discount": "#2E8B57",
    "out_of_stock": "#ADD8E6",
    "plain": "#ffffff",
}
# The price line of a card.
PRICE_BEFORE = "Цена: "
PRICE_AFTER = " руб."

# Limits of the table definitions.
MAX_TEXT = 255
MAX_DISCOUNT = 100
