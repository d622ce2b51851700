"""Grades, confidences, fees and classes: ordered rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of a source and its confidence, the first that is found counts.
SOURCE_CONFIDENCE = [
    (("dagalin_address_match",), 0.86),
    (("dadata",), 0.97),
    (("district", "unified_a"), 0.9),
    (("postgis", "court_districts", "unified_c"), 0.92),
    (("nearest", "courts_geo"), 0.65),
    (("coordinates_district", "reverse"), 0.88),
]
# Weights of geocoders, by their marks, and of any other.
GEOCODER_WEIGHTS = {"yandex": 1.0, "dadata": 0.9, "nominatim": 0.7}
OTHER_GEOCODER = 0.8
# Marks of an error message in the order in which they are looked for, its code, label and what to do.
ERRORS = [
    (("адрес не найден", "address_not_found"), "ERROR_ADDRESS_NOT_FOUND", "Адрес не найден", "Проверьте адрес, добавьте город и номер дома. Используйте формат: индекс, регион, город, улица, дом, квартира."),
    (("неоднозначн", "ambiguous"), "ERROR_AMBIGUOUS", "Неоднозначный адрес", "Уточните адрес: укажите регион или полный адрес."),
    (("низкая точность", "low_precision"), "ERROR_LOW_PRECISION", "Низкая точность геокодирования", "Адрес определён приблизительно. Уточните номер дома и квартиры."),
    (("суд не найден", "границы"), "ERROR_COURT_NOT_FOUND", "Суд не найден", "Точка не попадает в границы судебных участков. Проверьте координаты или адрес."),
    (("пустая строка",), "ERROR_EMPTY_ROW", "Пустая строка", "Заполните обязательные поля: адрес или ФИО."),
    (("адрес не указан",), "ERROR_NO_ADDRESS", "Адрес не указан", "Укажите адрес регистрации."),
    (("координат", "широт", "долгот"), "ERROR_INVALID_COORDS", "Некорректные координаты", "Широта: -90..90, долгота: -180..180. Проверьте формат координат."),
]
OTHER_ERROR = "ERROR_COURT_NOT_FOUND"
OTHER_ADVICE = "Обратитесь к документации или уточните данные вручную."
# Kinds of cases of exclusive jurisdiction.
EXCLUSIVE_KINDS = ("недвижимость", "права на недвижимость", "наследование недвижимости", "иск о правах на земельный участок")
# Words of a case's status, in the order in which they are looked for, and what to do.
STATUS_ACTIONS = [
    ("исполнено", "✅ Дело закрыто — снимаем с контроля"),
    ("исполнен", "✅ Дело закрыто — снимаем с контроля"),
    ("арест_имущества", "🔥 АВТО-ЗВОНОК: имущество на аукционе!"),
    ("арест", "🔥 Проверить арест имущества"),
    ("розыск", "🚨 СРОЧНО: должник скрылся"),
    ("приостановлено", "⏸️ Ждём разблокировки счетов"),
    ("приостановлен", "⏸️ Ждём разблокировки счетов"),
    ("возврат", "💰 АВТО-ПЕРЕДАН в МФО"),
    ("активно", "📋 На контроле, ждём исполнения"),
    ("ошибка", "⚠️ Требуется ручная проверка"),
]
STATUS_BLANK, STATUS_OTHER = "⚠️ Требуется ручная проверка", "📋 На контроле, ждём исполнения"
PENALTIES = (0.7, 0.6, 0.75, 0.5, 0.8, 0.8, 0.7, 0.75)


# Fixed values in what follows: floors and names of grades.
def ladder(c: Column, steps: list[tuple[float, str]], other: str) -> Column:
    """The first step whose floor the value reaches."""
    out = F.when(c >= steps[0][0], steps[0][1])
    for floor, name in steps[1:]:
        out = out.when(c >= floor, name)
    return out.otherwise(other)


def quality_grade(c: Column) -> Column:
    return ladder(c, [(0.98, "PERFECT"), (0.85, "GOOD"), (0.70, "WARNING")], "ERROR")


def document_grade(c: Column) -> Column:
    return ladder(c, [(0.98, "PERFECT"), (0.90, "GOOD"), (0.80, "WARNING"), (0.0, "POOR")], "MANUAL")


def checked_grade(c: Column, hits: Column) -> Column:
    return F.when((c >= 0.98) & (hits == 0), "PERFECT").when(c >= 0.92, "GOOD").when(c >= 0.85, "WARNING").otherwise("MANUAL")


def source_confidence(source: Column, steps: Column, geocoded: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    out = None
    for marks, value in SOURCE_CONFIDENCE:
        found = F.lit(False)
        for m in marks:
            found = found | F.contains(s, F.lit(m))
        out = F.when(found, value) if out is None else out.when(found, value)
    return out.when(geocoded, 0.85).when(steps > 0, 0.8)


def state_duty(debt: Column) -> Column:
    return F.when(debt > 0, F.round(F.least(F.lit(4000.0), debt * 0.032), 2)).otherwise(0.0)


def law_article(exclusive: Column, kind: Column) -> Column:
    found = F.lit(False)
    for w in EXCLUSIVE_KINDS:
        found = found | F.contains(F.lower(kind), F.lit(w))
    return F.when(F.coalesce(exclusive, F.lit(False)) | F.coalesce(found, F.lit(False)), 30).otherwise(28)


def action_of(status: Column, actions: list[tuple[str, str]] = STATUS_ACTIONS, blank: str = STATUS_BLANK, other: str = STATUS_OTHER) -> Column:
    """The action of the first key that the status holds or is held by."""
    s = F.lower(F.trim(status))
    out = F.when(F.coalesce(status, F.lit("")) == "", blank)
    for key, action in actions:
        out = out.when(F.contains(s, F.lit(key)) | F.contains(F.lit(key), s), action)
    return out.otherwise(other)


def error_class(message: Column) -> Column:
    """The code of the first mark that a message holds; a null message has the code of none."""
    m, out = F.lower(F.coalesce(message, F.lit(""))), None
    for marks, code, *_ in ERRORS:
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(m, F.lit(mark))
        out = F.when(found, code) if out is None else out.when(found, code)
    return out.otherwise(OTHER_ERROR)


def _by_code(code: Column, place: int, other: Column) -> Column:
    out = None
    for error in ERRORS:
        out = F.when(code == error[1], error[place]) if out is None else out.when(code == error[1], error[place])
    return F.when(code.isNotNull(), out.otherwise(other))


def error_label(code: Column) -> Column:
    return _by_code(code, 2, code)


def advice(code: Column) -> Column:
    return _by_code(code, 3, F.lit(OTHER_ADVICE))


def penalised(*failed: Column) -> Column:
    """1 times a penalty for each failed check, to 4 places."""
    out = F.lit(1.0)
    for f, p in zip(failed, PENALTIES):
        out = out * F.when(f, p).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 4)


def geocode_rank(confidence: Column) -> Column:
    return F.when(confidence == "exact", 4).when(confidence == "street", 3).when(confidence == "city", 2).otherwise(1)


def geocode_level(confidence: Column) -> Column:
    return F.when(confidence == "exact", "auto").when(confidence == "street", "semi").when(confidence == "city", "manual").otherwise("external")


def geocode_weight(source: Column) -> Column:
    out = None
    for name, w in GEOCODER_WEIGHTS.items():
        out = F.when(F.lower(source) == name, w) if out is None else out.when(F.lower(source) == name, w)
    return out.otherwise(OTHER_GEOCODER)


def ttl_days(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, 30).when(confidence >= 0.7, 7).otherwise(1)
