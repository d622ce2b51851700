"""Documents of courts: fields by pattern, validation, and checks of what a model has read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import grades, text

# Patterns of the fields, as first read and as held against a second reading.
FIELDS = {
    "section": r"(?iu)участок\s*[№#nN]*\s*(\d{1,3})",
    "case_number": r"(?iu)(?:дело\s*[№#]?\s*)?([2аА]\s*-\s*\d{1,4}/\d{4,6})",
    "debtor": r"(?iu)(?:взыскать\s+с|должник|ответчик)\s+([А-ЯЁ][а-яё\-]+\s+[А-ЯЁ][а-яё\-\.]+\s*[А-ЯЁ][а-яё\-\.]*)",
    "amount": r"(?iu)(\d{1,3}(?:\s\d{3})*)\s*руб",
}
SECOND_FIELDS = {
    "section": r"(?iu)(?:участок|суд\s*мирового)\s*[№nN#]*\s*(\d{1,3})",
    "case_number": r"(?iu)(?:дело|производство)\s*[№nN#]*\s*([2аА]\s*-\s*\d+/\d+)",
    "debtor": r"(?iu)([А-ЯЁ][а-яё]{2,})\s+([А-ЯЁ]\.[А-ЯЁ]\.)",
    "amount": r"(?iu)(\d{1,3}(?:\s\d{3})*(?:,\d{2})?)\s*(?:руб|р\.?)",
}
CASE_NUMBER = r"(?iu)^[2аА]\s*-\s*\d{1,4}/\d{4,6}$"
SUSPICIOUS_NAME = r"(?iu)^(?:Ааа|Ооо|Ххх|Qwe|Test)\s"
PATTERN_CONFIDENCE, LEAST_AMOUNT, MOST_AMOUNT = 0.85, 100, 50_000_000
UNKNOWN_COURT = "Не определено"


def extracted(c: Column) -> Column:
    """struct(section, case_number, debtor, amount, confidence): a document's fields; confidence is null if there is none."""
    part = {name: text.first_group(c, pattern) for name, pattern in FIELDS.items()}
    section, amount = part["section"].try_cast("int"), F.replace(part["amount"], F.lit(" "), F.lit("")).try_cast("double")
    case = F.regexp_replace(part["case_number"], r"\s+", "")
    found = F.coalesce(section.cast("string"), case, part["debtor"], part["amount"])
    confidence = F.when(found.isNotNull(), F.lit(PATTERN_CONFIDENCE))
    return F.struct(section.alias("section"), case.alias("case_number"), F.trim(part["debtor"]).alias("debtor"), amount.alias("amount"), confidence.alias("confidence"))


def valid_case_number(c: Column) -> Column:
    return F.coalesce(F.regexp_like(F.regexp_replace(F.trim(c), r"\s+", ""), F.lit(CASE_NUMBER)), F.lit(False))


def valid_amount(c: Column) -> Column:
    return F.coalesce(c.between(LEAST_AMOUNT, MOST_AMOUNT), F.lit(False))


def plausible_person(c: Column) -> Column:
    """Whether a name may be a person's; a blank one is not judged."""
    names = F.size(F.split(F.trim(c), r"\s+"))
    return ~text.not_blank(c) | (~F.regexp_like(F.trim(c), F.lit(SUSPICIOUS_NAME)) & (names >= 2))


def valid_result(court_name: Column, debtor: Column, amount: Column, confidence: Column, error: Column) -> Column:
    """Whether a result has what every result needs and no error."""
    placeless = (F.trim(court_name) == UNKNOWN_COURT) & ~text.not_blank(debtor)
    ok = ~text.not_blank(error) & text.not_blank(court_name) & amount.isNotNull() & (amount >= 0) & ~placeless & (F.coalesce(confidence, F.lit(0.0)) >= 0)
    return F.coalesce(ok, F.lit(False))


def consistency(c: Column, section: Column, case_number: Column, debtor: Column, amount: Column) -> Column:
    """A quarter for each field of a model's reading that the document's patterns confirm, amounts within 5 %.

    As the rule is written, a name is confirmed too where the model read none and the text has one.
    """
    seen = {name: F.trim(F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))) for name, pattern in SECOND_FIELDS.items()}
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\s+", "")
    read, own = F.trim(F.coalesce(debtor, F.lit(""))), seen["debtor"]
    worth = F.translate(F.replace(seen["amount"], F.lit(" "), F.lit("")), ",", ".").try_cast("double")
    near = (worth > 0) & (amount > 0) & (F.abs(worth - amount) / F.greatest(worth, F.lit(1.0)) < 0.05)
    hits = [
        section.cast("string") == seen["section"],
        (plain(case_number) != "") & (plain(case_number) == plain(seen["case_number"])),
        ((read != "") & F.contains(read, own)) | F.contains(own, read),
        near,
    ]
    total = F.lit(0.0)
    for hit in hits:
        total = total + F.when(F.coalesce(hit, F.lit(False)), 0.25).otherwise(0.0)
    return total


# Names of the checks, in the order of grades.PENALTIES.
CHECKS = ("structure", "court", "case_number", "ip_number", "amount", "debtor_fio", "self_check", "consistency")


def checked(document: Column, section: Column, case_number: Column, debtor: Column, amount: Column, court_name: Column, structure_ok: Column, court_known: Column, ip_known: Column, critic: Column) -> Column:
    """struct(failed, confidence, grade) of a model's reading of a document.

    structure_ok, court_known, ip_known (null: not asked) and critic (0 to 1, null: not
    asked) come from their own tables; blank fields are not checked.
    """
    no = F.lit(False)
    wrong = [
        ~F.coalesce(structure_ok, F.lit(True)),
        text.not_blank(court_name) & ~F.coalesce(court_known, no),
        text.not_blank(case_number) & ~valid_case_number(case_number),
        ~F.coalesce(ip_known, F.lit(True)),
        F.coalesce(amount != 0, no) & ~valid_amount(amount),
        ~F.coalesce(plausible_person(debtor), F.lit(True)),
        F.coalesce(critic < 0.8, no),
        text.not_blank(document) & (consistency(document, section, case_number, debtor, amount) < 0.5),
    ]
    failed = F.array_compact(F.array(*[F.when(w, name) for w, name in zip(wrong, CHECKS)]))
    confidence = grades.penalised(*wrong)
    return F.struct(failed.alias("failed"), confidence.alias("confidence"), grades.checked_grade(confidence, F.size(failed)).alias("grade"))
