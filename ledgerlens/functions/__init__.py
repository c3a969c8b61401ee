"""Column expressions. Every function returns a ``pyspark.sql.Column`` built
from native Spark functions, so it runs inside whole-stage codegen."""
from .identity import (digits_only, mask_card, national_code_valid, national_code_error,
                       card_error, normalize_mobile_e164, normalize_mobile_national)
from .network import ipv4_valid, ipv6_valid, ip_valid, ipv4_to_long, is_carrier_nat, ip_confidence
from .timeparse import parse_event_time, utc_text, local_text, is_night
from .format import thousands, percent_text, sha256_hex

__all__ = [
    "digits_only", "mask_card", "national_code_valid", "national_code_error", "card_error",
    "normalize_mobile_e164", "normalize_mobile_national", "ipv4_valid", "ipv6_valid", "ip_valid",
    "ipv4_to_long", "is_carrier_nat", "ip_confidence", "parse_event_time", "utc_text",
    "local_text", "is_night", "thousands", "percent_text", "sha256_hex",
]
