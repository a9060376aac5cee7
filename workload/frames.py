"""Governance state derived from the test tables, at whatever size they have.

``part`` gives tables, ``customer`` principals and protected rows, ``events``
an audit log.  The derivations cover odd names, two-column filters, shared mask
functions, every table kind, describe errors, half-done and finished
migrations, clashing tags, and missing functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions import names
from tablewarden.functions.names import KEY
from tablewarden.operators.tags import description_of
from tablewarden.plans.run import GovernanceState
from tablewarden.sources.store import shared_folder


def _text(c: Column) -> Column:
    return c.cast("string")


# Derived tables already written by this session: (application, folder, name) -> path.
_STORED: dict[tuple[str, str, str], str] = {}


class Frames:
    """Frames over one folder of test tables.

    Projections of a test table stay lazy.  Tables that take a shuffle to derive
    are written once per session, as a governance catalog would hold them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        at = (self.spark.sparkContext.applicationId, self.dir, name)
        if at not in _STORED:
            path = shared_folder(self.spark)
            build().write.parquet(path)
            _STORED[at] = path
        return self.spark.read.parquet(_STORED[at])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- principals and protected data --------------------------------------

    @cached_property
    def customers(self) -> DataFrame:
        c = self.read("customer")
        domain = F.when(F.col("c_nationkey") % 2 == 0, "a.example").otherwise("b.example")
        email = (
            F.when(F.col("c_custkey") % 97 == 0, "no-at-sign")
            .when(F.col("c_custkey") % 89 == 0, F.lit(None))
            .otherwise(F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@"), domain))
        )
        return c.select(
            "c_custkey",
            "c_name",
            email.alias("email"),
            F.concat(F.lit("+91"), F.lpad(_text(F.col("c_custkey")), 10, "0")).alias("phone"),
            "c_acctbal",
            F.col("c_mktsegment").alias("business_unit"),
        )

    @cached_property
    def membership(self) -> DataFrame:
        """Every tenth customer is in its segment's group, some in one more, a few are administrators."""
        key = F.col("c_custkey")
        groups = F.filter(
            F.array(
                F.when(key % 10 == 0, F.concat(F.lit("bu_"), "c_mktsegment")),
                F.when(key % 20 == 0, F.lit("bu_BUILDING")),
                F.when(key % 500 == 7, F.lit("admins")),
                F.when(key % 10 == 3, F.element_at(F.array(F.lit("rf_A"), F.lit("rf_N"), F.lit("rf_R")), (key % 3 + 1).cast("int"))),
            ),
            lambda g: g.isNotNull(),
        )
        return self.read("customer").select(
            F.explode(F.array_distinct(groups)).alias("group_name"), F.col("c_name").alias("member_email")
        )

    @cached_property
    def unit_groups(self) -> DataFrame:
        units = self.read("customer").select(F.col("c_mktsegment").alias("value")).distinct()
        return units.withColumn("group_name", F.concat(F.lit("bu_"), "value"))

    @cached_property
    def flag_groups(self) -> DataFrame:
        flags = self.read("lineitem").select(F.col("l_returnflag").alias("value")).distinct()
        return flags.withColumn("group_name", F.concat(F.lit("rf_"), "value"))

    # -- tables and their old rules ------------------------------------------

    @cached_property
    def tables(self) -> DataFrame:
        k = F.col("p_partkey")
        kind = F.element_at(
            F.array(*[F.lit(t) for t in ("MANAGED", "MANAGED", "MANAGED", "EXTERNAL", "STREAMING_TABLE", "MATERIALIZED_VIEW", "VIEW")]),
            (k % 7 + 1).cast("int"),
        )
        error = (
            F.when(k % 97 == 0, "BAD_REQUEST PERMISSION_DENIED on table")
            .when(k % 101 == 0, "BAD_REQUEST FAILED_JDBC.CONNECTION")
            .when(k % 103 == 0, "[DATA_SOURCE_NOT_FOUND] unsupported")
            .when(k % 107 == 0, "boom")
        )
        return self.read("part").select(
            k.alias("tid"),
            F.concat(F.lit("cat-"), _text(k % 5)).alias("catalog"),
            F.concat(F.lit("s_"), _text(k % 20)).alias("schema"),
            F.concat(F.lit("t_"), _text(k)).alias("table"),
            kind.alias("table_type"),
            error.alias("describe_error"),
        )

    def _described(self) -> DataFrame:
        return self.tables.where(F.col("describe_error").isNull())

    @cached_property
    def row_filters(self) -> DataFrame:
        columns = F.when(F.col("tid") % 13 == 0, F.array(F.lit("region"), F.lit("business_unit"))).otherwise(
            F.array(F.lit("region"))
        )
        fqn = F.concat_ws(".", "catalog", "schema", F.concat(F.lit("rf_region-"), _text(F.col("tid") % 11)))
        return self._described().where(F.col("tid") % 3 == 0).select(
            "tid", *KEY, fqn.alias("function_fqn"), columns.alias("using_columns"),
            F.concat(fqn, F.lit(" ON ("), F.array_join(columns, ","), F.lit(")")).alias("raw_text"),
        )

    @cached_property
    def masks(self) -> DataFrame:
        kinds = F.array(
            *[
                F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.lit(f).alias("fn"))
                for i, (c, f) in enumerate(
                    [("email", "mask_email"), ("phone", "mask_phone"), ("ssn", "mask_redact"), ("card", "mask_redact")]
                )
            ]
        )
        return (
            self._described()
            .where(F.col("tid") % 5 != 4)
            .select("tid", *KEY, F.explode(kinds).alias("m"))
            .where((F.col("tid") + F.col("m.i")) % 4 < 2)
            .select(
                "tid",
                *KEY,
                F.col("m.column").alias("column"),
                F.concat_ws(".", "catalog", "schema", "m.fn").alias("function_fqn"),
                F.lit("").alias("raw_text"),
                F.col("m.i").alias("position"),
            )
        )

    @cached_property
    def dump(self) -> DataFrame:
        return self.stored("dump", self._dump)

    def _dump(self) -> DataFrame:
        """DESCRIBE output: type, filter, mask section, a trap line, and a quoted line after the section."""
        per_mask = self.masks.groupBy(*KEY).agg(
            F.sort_array(F.collect_list(F.struct("position", "column", "function_fqn"))).alias("ms")
        )
        filters = self.row_filters.select(*KEY, F.col("function_fqn").alias("rf"), "using_columns")

        def ticked(c: Column) -> Column:
            return F.concat(F.lit("`"), F.replace(c, F.lit("."), F.lit("`.`")), F.lit("`"))

        def line(name: Column | str, value: Column | None) -> Column:
            return F.struct(
                (F.lit(name) if isinstance(name, str) else name).alias("name"),
                (F.lit(None).cast("string") if value is None else value).alias("value"),
            )

        on = F.concat(ticked(F.col("rf")), F.lit(" ON ("), F.array_join("using_columns", ", "), F.lit(")"))
        none = F.array().cast("array<struct<name:string,value:string>>")
        section = F.transform("ms", lambda m: line(m["column"], ticked(m["function_fqn"])))
        trap = F.when(F.col("table_type") == "MATERIALIZED_VIEW", F.array(line("Total Size (bytes)", F.lit("2137")))).otherwise(
            F.array(line("", F.lit("")))
        )
        lines = F.concat(
            F.array(line("id", F.lit("bigint")), line("Type", F.col("table_type"))),
            F.when(F.col("rf").isNotNull(), F.array(line("Row Filter", on))).otherwise(none),
            F.when(F.col("ms").isNotNull(), F.concat(F.array(line("# Column Masks", F.lit(""))), section)).otherwise(none),
            trap,
            F.array(line("Owner", F.lit("`a`.`b`.`c`"))),
        )
        return (
            self._described()
            .join(filters, KEY, "left")
            .join(per_mask, KEY, "left")
            .select(*KEY, F.posexplode(lines).alias("pos", "l"))
            .select(*KEY, "pos", "l.name", "l.value")
        )

    @cached_property
    def functions(self) -> DataFrame:
        return self.stored("functions", self._functions)

    def _functions(self) -> DataFrame:
        """Distinct functions; some are gone, some cannot be executed."""
        used = self.row_filters.select("tid", "function_fqn").unionByName(self.masks.select("tid", "function_fqn"))
        first = used.groupBy("function_fqn").agg(F.min("tid").alias("first_tid"))
        return first.where(F.col("first_tid") % 19 != 0).select(
            "function_fqn", (F.col("first_tid") % 23 != 0).alias("executable")
        )

    # -- what earlier runs left -----------------------------------------------

    @cached_property
    def live_row_filters(self) -> DataFrame:
        return self.row_filters.where(F.col("tid") % 4 != 0)

    @cached_property
    def live_masks(self) -> DataFrame:
        return self.masks.where(F.col("tid") % 4 != 0)

    def _migrated(self) -> DataFrame:
        """Objects of tables that an earlier run reached, with the function their policy calls."""
        reached = F.col("tid") % 4 < 2
        fields = ["tid", *KEY, "object_type", "slot", "function_fqn"]
        filters = self.row_filters.where(reached).withColumns(
            {"object_type": F.lit("ROW_FILTER"), "slot": F.lit("")}
        )
        masks = self.masks.where(reached).withColumns({"object_type": F.lit("COLUMN_MASK"), "slot": F.col("column")})
        return filters.select(*fields).unionByName(masks.select(*fields))

    def _minted_key(self) -> Column:
        is_filter = F.col("object_type") == "ROW_FILTER"
        return F.when(is_filter, names.tag_key("function_fqn", "row_filter")).otherwise(names.tag_key("function_fqn", "mask"))

    def policies(self, scope: str = "TABLE") -> DataFrame:
        return self.stored(f"policies_{scope}", lambda: self._policies(scope))

    def _policies(self, scope: str) -> DataFrame:
        is_filter = F.col("object_type") == "ROW_FILTER"
        calls = F.when(F.col("tid") % 17 == 0, F.concat("function_fqn", F.lit("_old"))).otherwise(F.col("function_fqn"))
        alias = F.when(is_filter, "mc_region").otherwise(names.match_alias("slot"))
        name = (
            F.when(is_filter, names.row_filter_policy_name("function_fqn", scope)).otherwise(
                names.mask_policy_name("slot", "function_fqn", scope)
            )
        )
        no_names = F.array().cast("array<string>")
        body = F.struct(
            F.col("object_type").alias("policy_type"),
            calls.alias("function_fqn"),
            F.array(
                F.struct(
                    self._minted_key().alias("tag_key"),
                    F.lit(None).cast("string").alias("tag_value"),
                    alias.alias("alias"),
                    F.when(is_filter, "region").otherwise(F.col("slot")).alias("source_column"),
                )
            ).alias("match_columns"),
            F.when(is_filter, F.array(alias)).otherwise(no_names).alias("using_columns"),
            F.when(~is_filter, alias).alias("target_alias"),
            F.array(F.lit("account users")).alias("to_principals"),
            no_names.alias("except_principals"),
            F.lit("").alias("comment"),
        )
        return (
            self._migrated()
            .select(names.securable(scope).alias("on_securable"), name.alias("policy_name"), "tid", "slot", body.alias("b"))
            .groupBy("on_securable", "policy_name")
            .agg(F.min_by("b", F.struct("tid", "slot")).alias("b"))
            .select("on_securable", "policy_name", "b.*")
        )

    @cached_property
    def raw_column_tags(self) -> DataFrame:
        return self.stored("raw_column_tags", self._raw_column_tags)

    def _raw_column_tags(self) -> DataFrame:
        """Tags as listed: '' is a key-only tag."""
        fields = [*KEY, "column", "tag_key", "tag_value"]
        minted = self._migrated().select(
            *KEY,
            F.when(F.col("object_type") == "ROW_FILTER", "region").otherwise(F.col("slot")).alias("column"),
            self._minted_key().alias("tag_key"),
            F.lit("").alias("tag_value"),
        )
        also = self.row_filters.where((F.col("tid") % 4 < 2) & (F.col("tid") % 13 == 0)).select(
            *KEY,
            F.lit("business_unit").alias("column"),
            names.tag_key("function_fqn", "row_filter").alias("tag_key"),
            F.lit("").alias("tag_value"),
        )
        key = F.concat(F.lit("pii_"), "column")
        value = F.when(F.col("tid") % 2 == 1, "").when(F.col("tid") % 8 == 2, "odd").otherwise("high")
        by_hand = self.masks.where(F.col("tid") % 4 >= 2).select(*KEY, "tid", "column", key.alias("tag_key"), value.alias("tag_value"))
        copies = by_hand.where(F.col("tid") % 10 == 2).withColumn("column", F.concat(F.lit("backup_"), "column"))
        return minted.unionByName(also).unionByName(by_hand.select(*fields)).unionByName(copies.select(*fields))

    @cached_property
    def column_tags(self) -> DataFrame:
        return self.raw_column_tags.withColumn("tag_value", F.nullif("tag_value", F.lit("")))

    @cached_property
    def governed_tags(self) -> DataFrame:
        return self.stored("governed_tags", self._governed_tags)

    def _governed_tags(self) -> DataFrame:
        """Tags made by hand, and minted ones of which some carry another description."""
        none = F.array().cast("array<string>")
        pii = (
            self.masks.where(F.col("column") != "card")
            .select("column")
            .distinct()
            .select(
                F.concat(F.lit("pii_"), "column").alias("tag_key"),
                F.when(F.col("column") == "ssn", none).otherwise(F.array(F.lit("high"), F.lit("low"))).alias("allowed_values"),
                F.lit("by hand").alias("description"),
            )
        )
        minted = (
            self._migrated()
            .select(self._minted_key().alias("tag_key"), "function_fqn")
            .groupBy("tag_key")
            .agg(F.min("function_fqn").alias("function_fqn"))
            .select(
                "tag_key",
                none.alias("allowed_values"),
                F.when(F.length("tag_key") % 7 == 0, "by hand").otherwise(description_of("function_fqn")).alias("description"),
            )
        )
        return pii.unionByName(minted)

    @cached_property
    def grant_rules(self) -> DataFrame:
        role = F.when(F.length("tag_key") % 2 == 0, "roles/tagPolicy.assigner").otherwise("roles/tagPolicy.manager")
        held = F.when(F.length("tag_key") % 3 == 0, F.array(F.lit("groups/stewards"))).otherwise(
            F.array(F.lit("groups/stewards"), F.lit("users/x@a.example"), F.lit("groups/other"))
        )
        return self.governed_tags.select("tag_key", role.alias("role"), held.alias("principals"))

    def state(self, scope: str = "TABLE", live: bool = True) -> GovernanceState:
        return GovernanceState(
            tables=self.tables.select(*KEY, "table_type", "describe_error"),
            row_filters=(self.live_row_filters if live else self.row_filters).drop("tid"),
            masks=(self.live_masks if live else self.masks).drop("tid"),
            policies=self.policies(scope),
            column_tags=self.column_tags,
            governed_tags=self.governed_tags,
            functions=self.functions,
            grant_rules=self.grant_rules,
        )

    # -- audit -------------------------------------------------------------

    @cached_property
    def audit(self) -> DataFrame:
        """One audit row per event; user ids are table ids."""
        t, kind, e = F.col("user_id"), F.col("event_type"), F.col("event_id")
        status = F.element_at(
            F.array(*[F.lit(s) for s in ("SUCCESS", "ABAC_APPLIED", "FAILED", "ALREADY_MIGRATED", "NOT_ELIGIBLE", "ROLLED_BACK")]),
            (e % 6 + 1).cast("int"),
        )
        return self.read("events").select(
            F.concat(F.lit("run-"), _text(e % 7)).alias("run_id"),
            F.lpad(_text(e), 12, "0").alias("attempt_id"),
            F.concat(F.lit("cat-"), _text(t % 5)).alias("catalog"),
            F.concat(F.lit("s_"), _text(t % 20)).alias("schema"),
            F.concat(F.lit("t_"), _text(t)).alias("table"),
            F.when(kind.isin("view", "click"), "ROW_FILTER").otherwise("COLUMN_MASK").alias("object_type"),
            F.when(kind == "error", "email").when(kind == "purchase", "phone").when(kind == "signup", "ssn").alias("masked_column"),
            status.alias("status"),
            F.when(status == "FAILED", "POLICY_VERIFY_FAILED").alias("error_code"),
            F.when(status.isin("SUCCESS", "ALREADY_MIGRATED"), "FINALIZED")
            .when(status == "ABAC_APPLIED", "ABAC_APPLIED")
            .when(status == "FAILED", "FAILED")
            .otherwise("NOT_APPLICABLE")
            .alias("migration_phase"),
            F.col("ts").cast("timestamp").alias("completed_at"),
        )

    @cached_property
    def audit_with_undo(self) -> DataFrame:
        """Audit rows that kept rollback data; every fiftieth is unreadable."""
        is_filter = F.col("object_type") == "ROW_FILTER"
        fn = F.concat_ws(".", "catalog", "schema", F.when(is_filter, F.concat(F.lit("rf_region-"), _text(F.length("table") % 11))).otherwise("mask_email"))
        policy = F.concat(
            F.lit('"abac_policies_created_by_this_run":[{"policy_name":"'),
            F.when(is_filter, "abac_migrated_row_filter").otherwise(F.concat(F.lit("abac_migrated_mask_"), "masked_column")),
            F.lit('","on_securable":"'), names.table_securable(), F.lit('","policy_type":"'), F.col("object_type"), F.lit('"}]'),
        )
        text = F.when(
            is_filter,
            F.concat(F.lit('{"original_row_filter":{"function":"'), fn, F.lit('","using_columns":["region"]},'), policy, F.lit("}")),
        ).otherwise(
            F.concat(F.lit('{"original_column_masks":[{"column":"'), "masked_column", F.lit('","function":"'), fn, F.lit('"}],'), policy, F.lit("}"))
        )
        n = F.col("attempt_id").cast("long")
        undo = F.when(n % 50 == 0, F.lit('{"original_row_filter": {"function"')).when(n % 3 != 1, text).when(n % 9 == 1, F.lit("{}"))
        return self.audit.withColumn("rollback_metadata", undo)
