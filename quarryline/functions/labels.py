"""Labels of codes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import _c

# What each code is called.
LABELS = {
    "phone_status": {"VALID": "معتبر", "PROBABLE": "احتمالاً معتبر", "UNVERIFIED": "اعتبارسنجی‌نشده", "INVALID": "نامعتبر", "QUARANTINED": "قرنطینه (نامرتبط)"},
    "band": {"VERY_HIGH": "اعتبار بسیار بالا", "HIGH": "اعتبار بالا", "MEDIUM": "اعتبار متوسط", "LOW": "اعتبار پایین", "INVALID": "نامعتبر"},
    "business_type": {
        "WHOLESALER": "عمده‌فروش", "DISTRIBUTOR": "پخش/توزیع‌کننده", "RETAILER": "خرده‌فروش", "MANUFACTURER": "تولیدکننده", "STORE": "فروشگاه", "UNKNOWN": "نامشخص",
    },
    "category": {"DETERGENT": "شوینده", "HYGIENE": "بهداشتی", "COSMETIC": "آرایشی و بهداشتی", "CELLULOSE": "سلولزی", "OTHER": "سایر"},
    "business_status": {"ACTIVE": "فعال", "QUARANTINED": "قرنطینه", "INVALID": "نامعتبر", "MERGED": "ادغام‌شده", "ARCHIVED": "بایگانی"},
    "source_kind": {
        "SEARCH_ENGINE": "موتور جستجو", "BUSINESS_DIRECTORY": "دایرکتوری تجاری", "COMPANY_SITE": "سایت شرکت", "OPEN_DATA": "داده باز", "SOCIAL": "شبکه اجتماعی عمومی",
        "FIXTURE": "داده آزمایشی",
    },
    "job_status": {"PENDING": "در انتظار", "RUNNING": "در حال اجرا", "PAUSED": "متوقف‌شده", "DONE": "پایان‌یافته", "FAILED": "خطا", "CANCELLED": "لغو‌شده"},
}


def label(code, kind: str) -> Column:
    """What a code is called; a code without a label stays as it is."""
    names = F.create_map(*(F.lit(x) for pair in LABELS[kind].items() for x in pair))
    return F.coalesce(names[_c(code)], _c(code))
