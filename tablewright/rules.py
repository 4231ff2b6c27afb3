"""Domain vocabularies, rule lists and spelling tables."""

from __future__ import annotations

# Keywords scored by domain detection, in tie-break order of the domains.
DOMAIN_KEYWORDS = {
    "financial": [
        "price", "amount", "revenue", "transaction", "payment", "invoice",
        "balance", "account", "tax", "currency", "gbp", "usd", "eur",
        "fee", "discount", "refund", "credit", "debit", "ledger",
        "profit", "loss", "margin",
    ],
    "medical": [
        "patient", "diagnosis", "icd", "prescription", "medication",
        "dosage", "clinical", "hospital", "admission", "discharge",
        "procedure", "nhs", "lab", "test", "result", "symptom",
        "treatment", "physician", "doctor", "nurse", "vital",
        "blood", "glucose", "blood_pressure", "heart_rate",
        "patient_id", "diagnosis_code", "dosage_mg", "ward",
        "medical_record", "ehr", "fhir", "mrn",
    ],
    "automotive": [
        "vehicle", "vin", "make", "model", "mileage", "odometer",
        "engine", "fuel", "transmission", "registration", "plate",
        "dealer", "service", "mot", "chassis", "manufacturer",
        "horsepower", "torque", "ev", "hybrid", "emission", "co2",
    ],
    "employment": [
        "employee", "staff", "salary", "wage", "payroll", "department",
        "job_title", "hire_date", "termination", "contract", "hours",
        "overtime", "leave", "absence", "appraisal", "manager",
        "headcount", "fte", "grade", "band", "pension",
        "ni_number", "national_insurance",
    ],
    "retail": [
        "product", "sku", "category", "inventory", "stock", "order",
        "customer", "purchase", "basket", "checkout", "shipping",
        "delivery", "return", "refund", "coupon", "promotion",
        "loyalty", "store", "channel", "quantity", "unit_price",
        "total_price",
    ],
}

# Rules of each domain. Transforms are named as in operators/transforms.py,
# validation rules as in operators/constraints.py.
DOMAIN_RULES = {
    "financial": {
        "sensitive_columns": [
            "account_number", "card_number", "iban", "sort_code", "cvv",
            "tax_id", "vat_number", "bank_account",
        ],
        "required_transforms": ["strip_currency_symbols", "standardise_dates", "dedup_by_id"],
        "forbidden_transforms": ["drop_null_rows", "drop_duplicate_rows"],
        "validation_rules": [
            "amount_non_negative", "currency_code_format", "transaction_id_unique", "date_iso8601",
        ],
        "default_watermark_column": "transaction_date",
    },
    "medical": {
        "sensitive_columns": [
            "patient_id", "nhs_number", "date_of_birth", "full_name", "address",
            "postcode", "diagnosis_code", "medication_name", "prescription_id", "gp_code",
        ],
        "required_transforms": ["fill_null_strings", "standardise_dates", "uppercase_icd"],
        "forbidden_transforms": ["drop_null_rows", "drop_duplicate_rows", "mask_or_hash_pii"],
        "validation_rules": ["no_negative_ages", "icd_format", "date_iso8601", "null_filled"],
        "default_watermark_column": "admission_date",
    },
    "automotive": {
        "sensitive_columns": ["vin", "registration_plate", "owner_name", "owner_address"],
        "required_transforms": [
            "uppercase_vin", "uppercase_registration", "standardise_dates", "normalise_fuel_type",
        ],
        "forbidden_transforms": ["drop_null_rows"],
        "validation_rules": ["vin_length", "year_range", "mileage_non_negative", "date_iso8601"],
        "default_watermark_column": "service_date",
    },
    "employment": {
        "sensitive_columns": [
            "employee_id", "national_insurance_number", "ni_number", "salary",
            "date_of_birth", "full_name", "address", "bank_account", "emergency_contact",
        ],
        "required_transforms": ["title_case", "standardise_dates", "normalise_department", "dedup_by_id"],
        "forbidden_transforms": ["drop_null_rows", "expose_salary_in_logs"],
        "validation_rules": ["salary_non_negative", "hours_range", "date_iso8601", "no_future_hire_date"],
        "default_watermark_column": "hire_date",
    },
    "retail": {
        "sensitive_columns": [
            "customer_id", "customer_email", "customer_name", "address", "payment_card_last4",
        ],
        "required_transforms": [
            "strip_currency_symbols", "standardise_dates", "dedup_by_id",
            "normalise_country", "flag_negative_quantity",
        ],
        "forbidden_transforms": ["drop_negative_quantity_rows", "drop_null_rows"],
        "validation_rules": [
            "unit_price_non_negative", "quantity_check", "discount_range", "date_iso8601", "country_canonical",
        ],
        "default_watermark_column": "transaction_date",
    },
}

# Spelling variants of the canonical countries.
COUNTRY_VARIANTS = {
    "UK": ("UK", "uk", "United Kingdom", "united kingdom", "U.K."),
    "Germany": ("Germany", "germany", "GERMANY", "Deutschland"),
    "France": ("France", "france", "FRANCE"),
    "Netherlands": ("Netherlands", "netherlands", "The Netherlands"),
    "Sweden": ("Sweden", "sweden", "SWEDEN"),
}

# Spelling variants of the canonical fuel types.
FUEL_VARIANTS = {
    "petrol": ("petrol", "gasoline", "gas", "unleaded"),
    "diesel": ("diesel", "derv"),
    "electric": ("electric", "ev", "bev"),
    "hybrid": ("hybrid", "hev", "phev", "plug-in hybrid"),
}

# ISO 4217 codes of the national currencies.
CURRENCY_CODES = tuple((
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BHD BIF BMD "
    "BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC "
    "CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL "
    "GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR "
    "ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP "
    "LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK "
    "MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR "
    "PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE "
    "SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD "
    "TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER "
    "ZAR ZMW ZWG"
).split())

# Envelope keys looked for in landed JSON, in order.
ENVELOPE_KEYS = ("data", "results", "items", "records", "rows")

# Delimiters tried on a header line, in order.
DELIMITERS = (",", "\t", ";", "|")


def rules_for(domain: str) -> dict:
    """The rules of a domain; an unknown domain has none."""
    empty = {
        "sensitive_columns": [], "required_transforms": [], "forbidden_transforms": [],
        "validation_rules": [], "default_watermark_column": None,
    }
    return {"domain": domain, **DOMAIN_RULES.get(domain, empty)}
