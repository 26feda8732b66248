import pytest
from pyspark.sql import functions as F

from spendspark.functions import text as X
from spendspark.operators import parse as P

IST, CAME = "Asia/Kolkata", 1_752_294_600_000  # 2025-07-12 10:00 local

CASES = [
    ("AX-HDFCBK", "Sent Rs.250.00 From A/C *1234 To CORNER SHOP On 12/07/25 Ref 519312345678 Not you? Call 1800", {"amount_paise": 25000, "direction": "DEBIT", "account_tail": "1234", "merchant_norm": "corner shop", "ref_no": "519312345678", "occurred_at": CAME}),
    ("VK-SBIUPI", "A/C X5678 debited by 120.055 on 12Jul25 trf to GREEN MART Refno 519300001111", {"amount_paise": 12000, "merchant_norm": "green mart"}),
    ("VM-ICICIB", "INR 1,299.00 spent on Credit Card XX9012 at BOOK HOUSE. Avl Limit: INR 50,000.00", {"amount_paise": 129900, "direction": "DEBIT", "balance_paise": 5000000, "channel": "CARD", "account_tail": "9012"}),
    ("AD-AXISBK", "Salary of INR 75,000 credited to a/c no. XX3456. Avl Bal INR 80,000.00", {"amount_paise": 7500000, "direction": "CREDIT", "balance_paise": 8000000}),
    ("VM-HDFCBK", "Rs 500 debited from A/c XX1111 and credited to some one", {"direction": "DEBIT"}),
    ("VM-HDFCBK", "123456 is the OTP for Rs 500", {"reject_reason": "otp"}),
    ("VM-HDFCBK", "Pre-approved loan of Rs 5,00,000. Apply now", {"reject_reason": "promotional"}),
    ("VM-HDFCBK", "Payment request of Rs 500 from X", {"reject_reason": "not a completed txn"}),
    ("VM-HDFCBK", "Your e-statement for Rs 500 spent", {"reject_reason": "informational"}),
    ("+91 98765 43210", "Rs 500 debited", {"reject_reason": "personal sender"}),
    ("VM-HDFCBK", "Account updated", {"reject_reason": "no amount"}),
    ("VM-HDFCBK", "Avl bal: Rs 500.00", {"reject_reason": "only balance amounts"}),
    ("VM-HDFCBK", "Rs 500 for you", {"reject_reason": "no direction keyword"}),
    ("XY-ZZZZZZ", "Rs 500 paid", {"reject_reason": "unknown sender, weak signal"}),
    ("VM-HDFCBK", None, {"reject_reason": "empty body"}),
    ("VM-HDFCBK", "Rs 90 debited from A/c XX1111 on 01-07-25", {"occurred_at": 1_751_351_400_000}),
    ("VM-HDFCBK", "Rs 90 debited from A/c XX1111 on 01-08-25", {"occurred_at": CAME}),
    ("VM-HDFCBK", "Rs 90 sent to a.friend@okbank from A/c XX1111", {"channel": "UPI", "vpa_handle": "okbank", "merchant_norm": "a.friend"}),
    ("VM-HDFCBK", "Rs 90 credited to A/c XX1111 from HAPPY PEOPLE PVT LTD on 12-07-25", {"merchant_norm": "happy people", "direction": "CREDIT"}),
]


def test_message_cases(spark):
    df = spark.createDataFrame([(i, s, b, CAME) for i, (s, b, _) in enumerate(CASES)], "i int, sender string, body string, received_at long")
    for r in P.parsed(df, IST).collect():
        want = CASES[r.i][2]
        assert {k: r[k] for k in want} == want, (CASES[r.i], r)
        assert ("reject_reason" in want) == (r.reject_reason is not None)


@pytest.mark.parametrize(
    "function, cases",
    [
        (X.sender_class, {"VM-HDFCBK": "BANK", "paytm": "PSP", "09876543210": "PERSONAL", "": "UNKNOWN", None: "UNKNOWN", "xhdfcbky": "BANK", "AD-CRED": "PSP", "hdfc": "UNKNOWN"}),
        (X.merchant_key, {"ACME Foods Pvt. Ltd": "acme foods", "Mr Tailor": "tailor", "a.b@bank": "a.b", None: "", " ": "", "STORE 12345": "store", "foo_bar*baz": "foo bar baz", "Cafe Mumbai India": "cafe"}),
        (X.ref_key, {"ab-12 34": "AB1234", "12345": None, "abcdef12": None, None: None}),
        (X.signed_paise, {"(1,200.50)": -120050, "₹ 99": 9900, "12.345": 1235, "50 Dr": -5000, "50 Cr": 5000, "-": None, "": None, None: None, "abc": None, "-7": -700}),
        (X.rupees, {5: "0.05", -12345: "-123.45", 0: "0.00"}),
        (X.compact_money, {99_900: "₹999", 150_000: "₹1.5k", 25_000_000: "₹2.5L", 1_000_000_000: "₹1.0Cr"}),
        (X.narration_merchant, {"UPI/1234567890/Corner Shop/okbank": "Corner Shop", "Payment to Green Mart": "Green Mart", "": None, "12/34": None}),
        (X.column_number, {"BC12": 54, "A1": 0, None: 0, "12": 0}),
        (X.location_confidence, {120_000: "HIGH", 600_000: "MEDIUM", 3_600_000: "LOW", 3_600_001: "NONE", -5: "HIGH"}),
    ],
)
def test_scalar_cases(spark, function, cases):
    kind = "long" if isinstance(next(iter(cases)), int) else "string"
    out = spark.createDataFrame([(k,) for k in cases], f"v {kind}").select("v", function(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in out} == cases


def test_file_days(spark):
    cases = {"08/05/26": "2026-05-08", "8-May-2026 10:30": "2026-05-08", "46150": "2026-05-08", "46150.5": "2026-05-08", "2026-5-8": "2026-05-08", "31-02-2026": None, "total": None, "19999": None}
    out = spark.createDataFrame([(k,) for k in cases], "v string").select("v", X.file_day(F.col("v")).cast("string").alias("r")).collect()
    assert {r.v: r.r for r in out} == cases
