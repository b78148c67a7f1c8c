"""Column types of the inputs and tables (Spark DDL strings)."""

MONEY = "decimal(18,2)"

LOG = """
    common struct<ar:string, ba:string, ch:string, is_new:string, md:string, mid:string,
                  os:string, uid:string, vc:string>,
    page struct<during_time:bigint, item:string, item_type:string, last_page_id:string,
                page_id:string, source_type:string>,
    start struct<entry:string, loading_time:bigint, open_ad_id:bigint, open_ad_ms:bigint,
                 open_ad_skip_ms:bigint>,
    displays array<struct<display_type:string, item:string, item_type:string, `order`:int,
                          pos_id:int>>,
    actions array<struct<action_id:string, item:string, item_type:string, ts:bigint>>,
    ts bigint
"""

CHANGE = """
    database string, tableName string, before map<string,string>, after map<string,string>,
    type string, seq bigint
"""

RULE = """
    sourceTable string, operateType string, sinkType string, sinkTable string,
    sinkColumns string, sinkPk string, sinkExtend string
"""

ORDER_INFO = f"""
    id bigint, province_id bigint, order_status string, user_id bigint, total_amount {MONEY},
    activity_reduce_amount {MONEY}, coupon_reduce_amount {MONEY}, original_total_amount {MONEY},
    feight_fee {MONEY}, expire_time string, create_time string, operate_time string
"""

ORDER_DETAIL = f"""
    id bigint, order_id bigint, sku_id bigint, order_price {MONEY}, sku_num bigint,
    sku_name string, create_time string, split_total_amount {MONEY},
    split_activity_amount {MONEY}, split_coupon_amount {MONEY}
"""

PAYMENT_INFO = f"""
    id bigint, order_id bigint, user_id bigint, total_amount {MONEY}, subject string,
    payment_type string, create_time string, callback_time string
"""

SENSOR = "id string, ts bigint, vc double"
