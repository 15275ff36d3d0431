"""Schemas of the documents and tables. Times are UTC epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(text: str) -> list[T.StructField]:
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType()}
    return [T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())]


MEASURES = T.ArrayType(T.StructType(_fields("measure:string quantity:double")))
IDS = "organization_id:string space_id:string consumer_id:string resource_id:string plan_id:string resource_instance_id:string"

USAGE = T.StructType([*_fields(f"start:long end:long dedup_id:string region:string {IDS}"), T.StructField("measured_usage", MEASURES)])
REQUIRED_USAGE = ["start", "end", "organization_id", "space_id", "resource_id", "plan_id", "resource_instance_id", "measured_usage"]
SPAN_EVENT = T.StructType([*_fields(f"kind:string id:string timestamp:long {IDS} correlation_id:string"), T.StructField("measured_usage", MEASURES)])
_META = T.StructField("metadata", T.StructType(_fields("guid:string created_at:long")))
APP_EVENT = T.StructType([_META, T.StructField("entity", T.StructType(_fields("state:string previous_state:string org_guid:string space_guid:string app_guid:string instance_count:double previous_instance_count:double memory_in_mb_per_instance:double previous_memory_in_mb_per_instance:double")))])
SERVICE_EVENT = T.StructType([_META, T.StructField("entity", T.StructType(_fields("state:string org_guid:string space_guid:string service_instance_guid:string service_instance_type:string service_guid:string service_label:string service_plan_name:string")))])

METERING_METRICS = T.StructType(_fields("plan_id:string metric:string unit:string type:string formula:string meter:string accumulate:string aggregate:string summarize:string"))
RATING_METRICS = T.StructType(_fields("plan_id:string metric:string rate:string charge:string"))
PRICES = T.StructType(_fields("plan_id:string metric:string country:string price:double"))
MAPPINGS = T.StructType(_fields("kind:string resource_type:string plan_name:string plan_id:string"))
ACCOUNTS = T.StructType([*_fields("account_id:string"), T.StructField("organizations", T.ArrayType(T.StringType())), *_fields("pricing_country:string license_type:string")])

#: What tells an instance of a plan in its place of the tree.
INSTANCE = ["organization_id", "space_id", "consumer_id", "resource_id", "plan_id", "resource_instance_id"]
#: What an instance's usage is accumulated by; the space and resource keep an instance in one place of the tree.
KEYS = [*INSTANCE, "metering_plan_id", "rating_plan_id", "pricing_plan_id"]
NODE = ["resource_id", "plan_id", "metering_plan_id", "rating_plan_id", "pricing_plan_id"]
