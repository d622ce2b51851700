"""Writers of the output formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import grades, text

# Columns of the payment format, the columns that fill them, and what stands where nothing is known.
PAYMENT = {
    "№ Договора": ("id", "contract_number"),
    "Банк получателя": ("УФК",),
    "БИК": ("БИК",),
    "ИНН": ("ИНН",),
    "КПП": ("КПП",),
    "№ Счета": ("Счет",),
    "Наименование получателя платежа": (),
    "КБК": ("КБК",),
    "ОКТМО": ("ОКТМО",),
    "№ казначейского счета": ("treasury_account",),
}
PAYMENT_DEFAULTS = {"Наименование получателя платежа": "Казначейство России (ФНС России)", "КБК": "18210803010011050110"}
# The kind of claim and what is enclosed with it.
CLAIM_KIND = "взыскание задолженности по договору микрозайма"
ATTACHMENTS = (
    "Копия договора микрозайма",
    "Расчёт задолженности",
    "Копия требования (претензии) о погашении задолженности",
    "Доказательства направления требования ответчику",
    "Квитанция об оплате государственной пошлины",
    "Доверенность представителя",
    "Копия искового заявления для ответчика",
)
#: What marks a file as UTF-8 to spreadsheet programs.
BYTE_ORDER_MARK = "\ufeff"
SHEET_ROWS = 1_048_575


def result_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in order, missing ones and nulls empty; each file begins with a byte order mark and the header."""
    picked = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    marked = [picked[0].alias(BYTE_ORDER_MARK + columns[0]), *picked[1:]]
    df.select(*marked).write.mode("overwrite").csv(path, sep=";", header=True, emptyValue="")


def payment_rows(df: DataFrame) -> DataFrame:
    """The payment format's columns of result rows; the first filled of id and contract_number is the contract's number."""

    def value(name: str, sources: tuple[str, ...]):
        have = [text.blank_to_null(F.col(c).cast("string")) for c in sources if c in df.columns]
        return F.coalesce(*have, F.lit(PAYMENT_DEFAULTS.get(name, "")))

    return df.select(*[value(name, sources).alias(name) for name, sources in PAYMENT.items()])


def error_rows(df: DataFrame) -> DataFrame:
    """Row number, address, label and advice of the rows with an error."""
    code = F.col("error_code")
    return df.filter("status = 'ERROR'").select("row_id", "address", grades.error_label(code).alias("label"), grades.advice(code).alias("recommendation"))


def statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def coloured(df: DataFrame, grade: str) -> DataFrame:
    """df with the colour of each row's grade, that of the last one for any other."""
    # Grades and their colours.
    colours = {"PERFECT": "C6EFCE", "GOOD": "FFF2CC", "WARNING": "F4B084", "POOR": "FF9999", "MANUAL": "FFE6CC"}
    named = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    return df.withColumn("color", F.coalesce(F.try_element_at(named, F.col(grade)), F.lit(colours["MANUAL"])))


def geojson_features(areas: DataFrame) -> DataFrame:
    """A feature's JSON for each area, its ring closed; one to a line, so that no task holds the collection."""
    closed = F.concat(F.transform("ring", lambda p: F.array(p["x"], p["y"])), F.slice(F.transform("ring", lambda p: F.array(p["x"], p["y"])), 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    others = [c for c in areas.columns if c != "ring"]
    return areas.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*others).alias("properties"))).alias("value"))


def claims(df: DataFrame) -> DataFrame:
    """row_id and a claim's document as nested JSON; columns that are not there count as empty."""

    def have(name: str, other=""):
        return F.coalesce(F.col(name), F.lit(other).cast(dict(df.dtypes)[name])) if name in df.columns else F.lit(other)

    amount = have("debt_amount", 0.0)
    number = text.digits(have("passport"))
    part = lambda **fields: F.struct(*[c.alias(n) for n, c in fields.items()])
    claim = part(
        court=part(name=have("court_name"), address=have("court_address"), index=have("court_index"), jurisdiction_type=have("jurisdiction_type"), gpk_article=have("gpk_article")),
        plaintiff=part(name=have("plaintiff_name"), inn=have("plaintiff_inn"), address=have("plaintiff_address")),
        defendant=part(
            fio=have("fio"),
            birth_date=have("birth_date"),
            passport_series=F.when(F.length(number) >= 4, F.left(number, F.lit(4))).otherwise(""),
            passport_number=F.when(F.length(number) >= 10, F.substring(number, 5, 6)).otherwise(""),
            passport_issued_by=have("issued_by"),
            passport_issue_date=have("passport_issue_date"),
            address_registration=have("address"),
            address_residence=F.coalesce(F.col("address_residence"), have("address")) if "address_residence" in df.columns else have("address"),
        ),
        claim=part(
            claim_type=F.lit(CLAIM_KIND),
            price=F.coalesce(F.col("price"), amount) if "price" in df.columns else amount,
            principal_debt=F.coalesce(F.col("principal_debt"), amount) if "principal_debt" in df.columns else amount,
            interest=have("interest", 0.0),
            penalty=have("penalty", 0.0),
            state_duty=F.col("state_duty") if "state_duty" in df.columns else grades.state_duty(amount),
        ),
        contract=part(
            number=have("contract_number"),
            date=have("contract_date"),
            amount=amount,
            term_to=have("contract_term_to"),
            interest_rate=have("interest_rate", 0.0),
            payment_schedule=have("payment_schedule"),
            way_of_conclusion=have("way_of_conclusion", "дистанционно"),
        ),
        facts=part(
            pretrial_order=part(is_required=have("pretrial_required", False), demand_sent=have("demand_sent", True), demand_date=have("demand_date"), demand_delivery_proof=have("demand_delivery_proof")),
            default_date=have("default_date"),
            calculation_period_from=have("calc_from"),
            calculation_period_to=have("calc_to"),
        ),
        attachments=F.array(*map(F.lit, ATTACHMENTS)),
    )
    return df.select("row_id", F.to_json(claim).alias("claim"))


def xlsx(sheets: dict[str, DataFrame], path) -> None:
    """A workbook of the sheets, to a path or an open file; a sheet that has more rows than the format holds is refused.

    Rows pass through the driver one partition at a time and go to the file as they come.
    """
    import zipfile
    from xml.sax.saxutils import escape

    for name, df in sheets.items():
        if df.count() > SHEET_ROWS:
            raise ValueError(f"sheet {name} has more than {SHEET_ROWS} rows")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in zip(numbers, sheets))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, df in zip(numbers, sheets.values()):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                out.write(_row(df.columns).encode())
                for row in df.toLocalIterator():
                    out.write(_row(row).encode())
                out.write(b"</sheetData></worksheet>")


def _row(values) -> str:
    from xml.sax.saxutils import escape

    return "<row>" + "".join(f'<c t="inlineStr"><is><t>{escape("" if v is None else str(v))}</t></is></c>' for v in values) + "</row>"
