"""The wide result row: 49 text columns for each debtor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import grades
from wardline.operators.joins import dimension

# The columns of the result in their order.
COLUMNS = [
    "Нормализованный адрес",
    "Уровень достоверности",
    "Требует проверки",
    "Уровень обработки",
    "Тип производства",
    "Наименование суда",
    "Код суда",
    "Адрес суда",
    "e-mail суда",
    "Телефон суда",
    "Сайт суда",
    "Госпошлина, руб.",
    "ID Отдела судебных приставов (ОСП)",
    "Код ОСП",
    "Наименование ОСП",
    "Адрес ОСП",
    "Телефон ОСП",
    "Эл. адрес ОСП",
    "УФК",
    "ОКТМО",
    "ИНН",
    "КПП",
    "Счет",
    "БИК",
    "КБК",
    "Банк",
    "Код ИФНС",
    "Сайт ИФНС",
    "Телефон ИФНС",
    "Адрес ИФНС",
    "Наименование вышестоящего суда",
    "Код вышестоящего суда",
    "Адрес вышестоящего суда",
    "Email вышестоящего суда",
    "Телефон вышестоящего суда",
    "Сайт вышестоящего суда",
    "УФК вышестоящего суда",
    "ОКТМО вышестоящего суда",
    "ИНН вышестоящего суда",
    "КПП вышестоящего суда",
    "Счет вышестоящего суда",
    "КБК вышестоящего суда",
    "БИК вышестоящего суда",
    "Банк вышестоящего суда",
    "Код ИФНС вышестоящего суда",
    "Сайт ИФНС вышестоящего суда",
    "Телефон ИФНС вышестоящего суда",
    "Адрес ИФНС вышестоящего суда",
    "Источник данных",
]
# Sources and what they are called in the result.
SOURCE_LABELS = {
    "postgis": "PostGIS (границы участков)",
    "court_districts": "Полигоны участков (court_districts)",
    "coordinates_district": "Обратное геокодирование + район",
    "courts_nearest": "Ближайший суд (courts)",
    "courts_geo": "Ближайший суд (courts_geo)",
    "address_district": "Парсинг адреса (регион, район)",
    "dadata": "DaData API",
    "unified_A_district": "Парсинг адреса (регион, район) [unified]",
    "unified_B_dadata": "DaData API [unified]",
    "unified_C_postgis": "PostGIS [unified]",
}
# Fixed value: the budget code of court fees.
FEE_CODE = "18210803010011050110"
DETAILS = ["УФК", "ОКТМО", "ИНН", "КПП", "Счет", "БИК", "Банк"]


def wide_rows(resolved: DataFrame, regions: DataFrame, details: DataFrame) -> DataFrame:
    """row_id and the 49 columns, empty where nothing is known.

    resolved: row_id, normalized_address, confidence, needs_manual_review, level,
    case_type, exclusive, court_name, region, section_num, address, email, phone, source,
    debt_amount; regions: region, region_code, site; details: region, section_num and the
    payment columns.
    """
    labels = F.create_map(*[F.lit(x) for pair in SOURCE_LABELS.items() for x in pair])
    section = F.coalesce(F.trim(F.col("section_num").cast("string")).try_cast("int"), F.lit(0))
    rows = resolved.withColumn("_section", section).join(dimension(regions.select("region", "region_code", "site")), "region", "left")
    right = details.select("region", F.coalesce(F.col("section_num").cast("int"), F.lit(0)).alias("_section"), *DETAILS)
    rows = rows.join(dimension(right), ["region", "_section"], "left")
    article = grades.law_article(F.col("exclusive"), F.col("case_type"))
    values = {
        "Нормализованный адрес": F.col("normalized_address"),
        "Уровень достоверности": F.col("confidence").cast("string"),
        "Требует проверки": F.when(F.col("needs_manual_review"), "Да"),
        "Уровень обработки": F.col("level"),
        "Тип производства": F.concat(F.lit("Гражданское (ст. "), article.cast("string"), F.lit(" ГПК РФ)")),
        "Наименование суда": F.col("court_name"),
        "Код суда": F.concat(F.coalesce("region_code", F.lit("")), F.when(F.col("_section") != 0, F.col("_section").cast("string")).otherwise("")),
        "Адрес суда": F.col("address"),
        "e-mail суда": F.col("email"),
        "Телефон суда": F.col("phone"),
        "Сайт суда": F.col("site"),
        "Госпошлина, руб.": F.when(F.col("debt_amount") > 0, F.format_string("%.2f", grades.state_duty(F.col("debt_amount")))),
        "КБК": F.lit(FEE_CODE),
        "Источник данных": F.try_element_at(labels, F.col("source")),
    } | {c: F.col(c).cast("string") for c in DETAILS}
    filled = [F.coalesce(F.nullif(F.trim(values[c]), F.lit("")), F.lit("")) if c in values else F.lit("") for c in COLUMNS]
    return rows.select("row_id", *[v.alias(c) for v, c in zip(filled, COLUMNS)])
