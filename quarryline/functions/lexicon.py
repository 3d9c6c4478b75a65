"""Weighted terms of topics, roles and signals, and how a file extends them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

Terms = tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class Lexicon:
    """Terms by category and by role, signs of a business, terms against it, and marks of spam."""

    categories: dict[str, Terms] = field(default_factory=dict)
    roles: dict[str, Terms] = field(default_factory=dict)
    signals: Terms = ()
    negatives: Terms = ()
    spam: Terms = ()

    def extended(self, more: dict) -> Lexicon:
        """Adds the terms of a reference file (the first of a term wins); a group given as {"replace": true, "terms": [...]} is replaced."""

        def merged(base: Terms, extra) -> Terms:
            if isinstance(extra, dict):
                new = tuple((t, float(w)) for t, w in extra.get("terms", []))
                return new if extra.get("replace") and new else merged(base, new)
            known = {t for t, _ in base}
            out = list(base)
            for t, w in extra or ():
                if t not in known:
                    known.add(t)
                    out.append((t, float(w)))
            return tuple(out)

        groups = lambda own, extra: {k: merged(own.get(k, ()), (extra or {}).get(k)) for k in dict.fromkeys([*own, *(extra or {})])}
        return replace(self, categories=groups(self.categories, more.get("categories")), roles=groups(self.roles, more.get("roles")), negatives=merged(self.negatives, more.get("negative")))


def load(spark: SparkSession, path: str, base: Lexicon | None = None) -> Lexicon:
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return (base or DEFAULT).extended(json.loads(text) if text.strip() else {})


# Fixed values.
DEFAULT = Lexicon(
    categories={
        "DETERGENT": (
            ("مواد شوینده", 3),
            ("شوینده", 3),
            ("شوینده ها", 2.5),
            ("مایع ظرفشویی", 3),
            ("مایع دستشویی", 3),
            ("مایع دستشویى", 3),
            ("پودر لباسشویی", 3),
            ("مایع لباسشویی", 3),
            ("نرم کننده لباس", 2.5),
            ("سفیدکننده", 2.5),
            ("وایتکس", 2.5),
            ("جرمگیر", 2.5),
            ("جرم گیر", 2),
            ("شامپو فرش", 2.5),
            ("شیشه شور", 2),
            ("ضدعفونی کننده", 3),
            ("ضد عفونی", 2.5),
            ("محلول ضدعفونی", 3),
            ("پاک کننده", 2),
            ("صابون", 1.5),
            ("دستمال مرطوب", 1.5),
            ("اسپری خوشبوکننده", 1.5),
            ("خوشبوکننده", 1),
            ("شوینده صنعتی", 3),
            ("مواد شیمیایی", 1),
            ("جوش شیرین", 1),
            ("نمک صنعتی", 0.8),
        ),
        "HYGIENE": (
            ("محصولات بهداشتی", 3),
            ("لوازم بهداشتی", 3),
            ("بهداشتی", 2.5),
            ("بهداشت شخصی", 3),
            ("پوشک", 3),
            ("نوار بهداشتی", 3),
            ("دستمال کاغذی", 2.5),
            ("دستمال بهداشتی", 3),
            ("گوش پاک کن", 2),
            ("پنبه بهداشتی", 2),
            ("ماسک", 1.5),
            ("محلول ضدعفونی", 2.5),
            ("ژل ضدعفونی", 2.5),
            ("پد بهداشتی", 2.5),
            ("پنبه", 1.2),
        ),
        "COSMETIC": (
            ("آرایشی و بهداشتی", 3),
            ("لوازم آرایشی", 3),
            ("محصولات آرایشی", 3),
            ("مواد آرایشی", 3),
            ("لوازم آرایش", 3),
            ("آرایشی", 2.5),
            ("ادکلن", 2),
            ("عطر", 1.8),
            ("کرم", 1.5),
            ("رژ لب", 2),
            ("خط چشم", 2),
            ("لاک ناخن", 2),
            ("رنگ مو", 2),
            ("میکاپ", 2),
            ("شامپو", 1.6),
            ("لوازم پیرایش", 1.5),
            ("لوازم آرایشگاهی", 2.5),
            ("محصولات زیبایی", 2),
        ),
        "CELLULOSE": (
            ("محصولات سلولزی", 3),
            ("سلولزی", 3),
            ("دستمال کاغذی", 3),
            ("کاغذ توالت", 3),
            ("دستمال توالت", 3),
            ("حوله کاغذی", 3),
            ("کاغذ بهداشتی", 3),
            ("دستمال جیبی", 2),
            ("ظرف یکبار مصرف", 1.5),
            ("کاغذ", 0.8),
            ("پوشک", 1.5),
            ("نوار بهداشتی", 1.2),
        ),
    },
    roles={
        "WHOLESALER": (
            ("عمده فروشی", 4),
            ("عمده فروش", 4),
            ("فروش عمده", 4),
            ("بنکداری", 3),
            ("بنکدار", 3),
            ("عمده", 1.5),
        ),
        "DISTRIBUTOR": (
            ("پخش", 3),
            ("پخش کننده", 4),
            ("پخش سراسری", 4),
            ("توزیع کننده", 4),
            ("توزیع", 3),
            ("کارگزار", 1.5),
            ("واردکننده", 2),
            ("صادرکننده", 1.2),
            ("نمایندگی", 3),
            ("نماینده فروش", 3),
            ("عامل فروش", 2.5),
        ),
        "RETAILER": (
            ("خرده فروشی", 3),
            ("خرده فروش", 3),
            ("فروشگاه", 2),
            ("سوپرمارکت", 1.2),
            ("فروش", 1),
            ("عرضه", 1),
            ("مرکز فروش", 2),
        ),
        "MANUFACTURER": (
            ("تولیدکننده", 3),
            ("تولیدی", 2.5),
            ("کارخانه", 2.5),
            ("صنایع", 1.5),
            ("خط تولید", 2),
            ("کارگاه", 1),
        ),
    },
    signals=(
            ("ساعات کاری", 1.5),
            ("تماس با ما", 1.5),
            ("ارتباط با ما", 1.2),
            ("آدرس", 1),
            ("تلفن", 1),
            ("نمابر", 0.8),
            ("فکس", 0.8),
            ("واتساپ", 1),
            ("ثبت سفارش", 1.2),
            ("خرید عمده", 2),
            ("ارسال به سراسر کشور", 1.8),
            ("ارسال به تمام نقاط", 1.5),
            ("لیست قیمت", 1),
            ("کاتالوگ", 0.8),
            ("نمایندگی در", 1.5),
            ("شبکه توزیع", 2),
            ("سفارش تلفنی", 1),
            ("پیک", 0.5),
        ),
    negatives=(
            ("استخدام", 2.5),
            ("نیازمندیم", 2.5),
            ("رزومه", 2),
            ("فرصت شغلی", 2),
            ("پخش زنده", 3.5),
            ("پخش آنلاین", 3),
            ("تماشای آنلاین", 2.5),
            ("فیلم", 1.2),
            ("سریال", 1.2),
            ("دانلود", 1.5),
            ("شرط بندی", 4),
            ("شرط\u200cبندی", 4),
            ("همسریابی", 4),
            ("همسر یابی", 4),
            ("فال", 2),
            ("طلسم", 2.5),
            ("وام", 2),
            ("تسهیلات بانکی", 1.5),
            ("بازی آنلاین", 2.5),
            ("اخبار", 1),
            ("آموزش سئو", 1.5),
            ("خرید فالوور", 4),
            ("افزایش ممبر", 4),
            ("رمز ارز", 2.5),
            ("کریپتو", 2.5),
            ("دستور پخت", 2),
            ("آشپزی", 1.2),
        ),
    spam=(
            ("خرید فالوور", 5),
            ("شرط بندی", 5),
            ("شرط\u200cبندی", 5),
            ("همسریابی", 5),
            ("تست کانال", 2),
            ("لینک دانلود", 2),
            ("گلچین", 1),
            ("اسپم", 3),
        ),
)
QUERY_KEYWORDS = {
    "DETERGENT": ("مواد شوینده", "شوینده", "مایع ظرفشویی", "پودر لباسشویی"), "HYGIENE": ("محصولات بهداشتی", "لوازم بهداشتی", "پوشک و نوار بهداشتی"),
    "COSMETIC": ("لوازم آرایشی و بهداشتی", "محصولات آرایشی", "پخش لوازم آرایشی"), "CELLULOSE": ("محصولات سلولزی", "دستمال کاغذی", "کاغذ بهداشتی"),
}
QUERY_ROLES = {
    "WHOLESALER": ("عمده فروشی", "عمده فروش"), "DISTRIBUTOR": ("پخش", "توزیع کننده", "نمایندگی"), "RETAILER": ("فروشگاه", "خرده فروشی"),
    "MANUFACTURER": ("تولیدکننده", "کارخانه"),
}
QUERY_SHAPES = (
    "{role} {category} {city}", "{category} {city}", "{role} {category} {city} {province}", "{category} {city} خرید عمده", "{role} {category} {county}",
    "{category} {city} پخش سراسری", "{role} {category} {city} شماره تماس", "{category} {city} لیست قیمت", "{category} {city} نمایندگی",
    "{role} {category} {city} آدرس", "{category} {city} انبار", "{role} {category} {city} واتساپ",
)
# Words in names that tell no business from another.
GENERIC_TOKENS = (
    "شرکت", "مؤسسه", "موسسه", "تعاونی", "اتحادیه", "سهامی", "خاص", "عام", "مسئولیت", "محدود", "تولیدی", "صنعتی", "تجاری", "بازرگانی", "دفتر", "شعبه",
    "نمایندگی", "نمایندگى", "کارخانه", "کارگاه", "مرکز", "مجموعه", "گروه", "بنگاه", "پخش", "عمده", "عمدهفروشی", "عمدهفروش", "خرده", "خردهفروشی",
    "خردهفروش", "فروشی", "فروشى", "فروش", "فروشگاه", "فروشگاهى", "مغازه", "توزیع", "توزیعکننده", "وارد", "واردکننده", "صادر", "صادرکننده", "عرضه",
    "تأمین", "تامین", "تأمینکننده", "مواد", "محصولات", "محصول", "لوازم", "کالا", "اجناس", "انواع", "ملزومات", "شوینده", "شویندهها", "شویندههای",
    "شویندههاى", "بهداشتی", "بهداشتى", "بهداشت", "آرایشی", "آرایشى", "آرایش", "سلولزی", "سلولز", "پاککننده", "شیمیایی", "شیمی", "صنایع", "کلینیک",
    "ایران", "ایرانی", "فارس", "مرکزی", "اصلی", "بزرگ", "گسترش", "پیشرو", "مدرن", "نوین", "برتر", "منطقه", "استان", "شهر", "شهرستان", "بازار",
    "بازرگان",
)
