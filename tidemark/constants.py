"""The codes the source systems write. They must stay as they are."""

# Business code -> (group, meaning).
BUSINESS_CODES = {
    "1001": ("order_status", "unpaid"),
    "1002": ("order_status", "paid"),
    "1003": ("order_status", "cancelled"),
    "1004": ("order_status", "finished"),
    "1005": ("order_status", "refunding"),
    "1006": ("order_status", "refunded"),
    "1101": ("payment_type", "alipay"),
    "1102": ("payment_type", "wechat"),
    "1103": ("payment_type", "union"),
    "1201": ("appraise", "good"),
    "1202": ("appraise", "so-so"),
    "1203": ("appraise", "bad"),
    "1204": ("appraise", "automatic"),
    "1301": ("refund_reason", "bad goods"),
    "1302": ("refund_reason", "wrong description"),
    "1303": ("refund_reason", "sold out"),
    "1304": ("refund_reason", "wrong size"),
    "1305": ("refund_reason", "ordered by mistake"),
    "1306": ("refund_reason", "no reason"),
    "1307": ("refund_reason", "other"),
    "1401": ("coupon_status", "unused"),
    "1402": ("coupon_status", "in use"),
    "1403": ("coupon_status", "used"),
    "1501": ("refund_type", "money only"),
    "1502": ("refund_type", "money and goods"),
    "2401": ("source_type", "query"),
    "2402": ("source_type", "promotion"),
    "2403": ("source_type", "recommendation"),
    "2404": ("source_type", "activity"),
    "3101": ("activity_rule_type", "full reduction"),
    "3102": ("activity_rule_type", "full discount"),
    "3103": ("activity_rule_type", "discount"),
    "3201": ("coupon_type", "full reduction"),
    "3202": ("coupon_type", "full discount"),
    "3203": ("coupon_type", "voucher"),
    "3301": ("coupon_range", "category3"),
    "3302": ("coupon_range", "trademark"),
    "3303": ("coupon_range", "spu"),
}

APPRAISE_GOOD = "1201"

# Weight of one keyword hit by where it came from; any other source weighs 0.
KEYWORD_WEIGHTS = {"SEARCH": 10, "ORDER": 3, "CART": 2, "CLICK": 1}

# Sink types a routing rule may name.
SINK_KAFKA = "kafka"
SINK_HBASE = "hbase"

# Fixed value: the one text format of timestamps in facts and aggregate tables.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
