"""Demo data of any size, memberships, and the nine-table fixture matrix.

Values are picked by hashing (seed, id, field), so a row depends on nothing
but its own id: generation needs no shuffle and repeats exactly.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.sources.schemas import MEMBERSHIP, schema

# The two business units and their groups.
UNITS = {"Retail": "bu_retail_group", "O2C": "bu_o2c_group"}

_FIRST = ["Asha", "Bela", "Chet", "Devi", "Esha", "Farid", "Gita", "Hari", "Indu", "Jaya"]
_LAST = ["Anand", "Basu", "Chopra", "Desai", "Eapen", "Ganguly", "Hegde", "Jain"]
_PLACES = [("Mumbai", "Maharashtra"), ("Surat", "Gujarat"), ("Delhi", "Delhi"), ("Chennai", "Tamil Nadu")]
_ROADS = ["Hill Road", "Lake Road", "Market Street", "Station Road"]
_METHODS = ["CREDIT_CARD", "UPI", "NET_BANKING", "DEBIT_CARD", "WIRE_TRANSFER"]
_GOODS = {"Retail": ["Shirt", "Lamp", "Kettle", "Shoes", "Mixer", "Jacket", "Radio", "Bag"],
          "O2C": ["Polymer", "Solvent", "Diesel", "Resin", "Glycol", "Jet fuel", "Benzene", "Xylene"]}
_DOMAIN = {"Retail": "shop.example", "O2C": "partner.example"}


class DemoData:
    """Tables of one demo catalog.

    Odd ids of customers, reps and orders are one unit, even ids the other; the
    first half of the products belongs to Retail.  An order's customer and rep
    are picked among ids of its own parity, its product from its unit's half.
    """

    def __init__(self, seed: str, n_customers: int = 20, n_reps: int = 10, n_products: int = 16):
        self.seed, self.n_customers, self.n_reps, self.n_products = seed, n_customers, n_reps, n_products

    def _hash(self, field: str, row_id: str | Column = "id") -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(field), F.col(row_id) if isinstance(row_id, str) else row_id)

    def _int(self, field: str, low: int, high: int, row_id: str | Column = "id") -> Column:
        return F.pmod(self._hash(field, row_id), F.lit(high - low + 1)) + low

    def _pick(self, field: str, values: list[str], row_id: str | Column = "id") -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self._int(field, 1, len(values), row_id).cast("int"))

    def _digits(self, field: str, n: int) -> Column:
        return F.lpad(F.pmod(self._hash(field), F.lit(10**n)).cast("string"), n, "0")

    def _date(self, field: str, first_year: int, last_year: int | None = None) -> Column:
        year = self._int(field + "y", first_year, last_year or first_year).cast("int")
        return F.make_date(year, self._int(field + "m", 1, 12).cast("int"), self._int(field + "d", 1, 28).cast("int"))

    def _same_unit(self, field: str, n: int) -> Column:
        """An id in 1..n of the same parity as the row's id."""
        half = F.pmod(self._hash(field), F.lit(n // 2))
        return half * 2 + F.when(F.col("id") % 2 == 0, 2).otherwise(1)

    @staticmethod
    def unit(row_id: str = "id") -> Column:
        return F.when(F.col(row_id) % 2 == 0, "Retail").otherwise("O2C")

    def _name(self, field: str) -> Column:
        return F.concat_ws(" ", self._pick(field + "f", _FIRST), self._pick(field + "l", _LAST))

    def _phone(self, field: str) -> Column:
        return F.concat(F.lit("+91"), self._int(field + "p", 6, 9).cast("string"), self._digits(field, 9))

    def _email(self, field: str, domain: Column) -> Column:
        user = F.lower(F.concat_ws(".", self._pick(field + "f", _FIRST), self._pick(field + "l", _LAST)))
        return F.concat(user, self._int(field + "n", 1, 999).cast("string"), F.lit("@"), domain)

    def _place(self, row_id: str = "id") -> Column:
        """City and state of a customer, from its id alone."""
        places = F.array(*[F.struct(F.lit(c).alias("city"), F.lit(s).alias("state")) for c, s in _PLACES])
        return F.element_at(places, self._int("place", 1, len(_PLACES), row_id).cast("int"))

    def _is_retail_product(self, product_id: str) -> Column:
        return F.col(product_id) <= self.n_products // 2

    def unit_price(self, product_id: str = "product_id") -> Column:
        """Price of a product, from its id alone, so that orders need no join for it."""
        cents = F.when(self._is_retail_product(product_id), self._int("price", 19_900, 4_999_900, product_id)).otherwise(
            self._int("price", 5_000_000, 500_000_000, product_id)
        )
        return (cents.cast("decimal(14,0)") / 100).cast("decimal(12,2)")

    def customers(self, ids: DataFrame) -> DataFrame:
        at = self._place()
        domain = F.when(F.col("id") % 2 == 0, _DOMAIN["Retail"]).otherwise(_DOMAIN["O2C"])
        letters = F.translate(self._digits("pan1", 5), "0123456789", "ABCDEFGHIJ")
        return ids.select(
            F.col("id").alias("customer_id"),
            self._name("who").alias("full_name"),
            self._email("who", domain).alias("email"),
            self._phone("phone").alias("phone_number"),
            F.concat(letters, self._digits("pan2", 4), F.translate(self._digits("pan3", 1), "0123456789", "KLMNOPQRST")).alias("pan_number"),
            self._digits("aadhaar", 12).alias("aadhaar_number"),
            F.concat_ws(" ", self._int("no", 1, 999).cast("string"), self._pick("road", _ROADS)).alias("address"),
            at["city"].alias("city"),
            at["state"].alias("state"),
            self.unit().alias("business_unit"),
            self._date("signup", 2024).alias("signup_date"),
        )

    def sales_reps(self, ids: DataFrame) -> DataFrame:
        return ids.select(
            F.col("id").alias("rep_id"),
            self._name("rep").alias("rep_name"),
            self._email("rep", F.lit("sales.example")).alias("rep_email"),
            self._phone("repphone").alias("rep_phone"),
            self.unit().alias("business_unit"),
            self._date("hired", 2020, 2024).alias("hire_date"),
            self._pick("region", [c for c, _ in _PLACES]).alias("region"),
        )

    def products(self, ids: DataFrame) -> DataFrame:
        retail = self._is_retail_product("id")
        name = F.when(retail, self._pick("good", _GOODS["Retail"])).otherwise(self._pick("good", _GOODS["O2C"]))
        return ids.select(
            F.col("id").alias("product_id"),
            name.alias("product_name"),
            F.when(retail, "Household").otherwise("Petrochemicals").alias("category"),
            self.unit_price("id").alias("unit_price"),
            F.when(retail, "Retail").otherwise("O2C").alias("business_unit"),
        )

    def orders(self, ids: DataFrame) -> DataFrame:
        half = self.n_products // 2
        product = F.pmod(self._hash("product"), F.lit(half)) + F.when(F.col("id") % 2 == 0, 1).otherwise(half + 1)
        at = self._place("customer_id")
        picked = ids.select(
            "id",
            self._same_unit("customer", self.n_customers).alias("customer_id"),
            self._same_unit("rep", self.n_reps).alias("rep_id"),
            product.alias("product_id"),
            self._int("quantity", 1, 20).cast("int").alias("quantity"),
        )
        return picked.select(
            F.col("id").alias("order_id"),
            "customer_id",
            "rep_id",
            "product_id",
            self._date("ordered", 2025).alias("order_date"),
            "quantity",
            (F.col("quantity") * self.unit_price()).cast("decimal(14,2)").alias("order_amount"),
            self.unit().alias("business_unit"),
            F.concat(
                self._int("dock", 1, 999).cast("string"), F.lit(" "), at["city"], F.lit(" Logistics Park, "), at["state"]
            ).alias("shipping_address"),
        )

    def payments(self, orders: DataFrame) -> DataFrame:
        """One payment per order; its id is the order's."""
        rows = orders.withColumn("id", F.col("order_id"))
        return rows.select(
            F.col("id").alias("payment_id"),
            "order_id",
            self._pick("method", _METHODS).alias("payment_method"),
            self._digits("card", 16).alias("card_number"),
            self._name("holder").alias("card_holder_name"),
            F.col("order_amount").alias("amount"),
            F.col("order_date").alias("payment_date"),
            "business_unit",
        )


def ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1)


def membership(spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """``(group_name, member_email)`` pairs as the membership frame; write it with overwrite to seed."""
    return spark.createDataFrame(list(pairs), schema(MEMBERSHIP))


# Table kinds and what protects a table in the fixture matrix.
MATRIX_KINDS = {"managed": "MANAGED", "streaming": "STREAMING_TABLE", "mv": "MATERIALIZED_VIEW"}
MATRIX_FLAVOURS = ("rls", "mask", "both")


def matrix(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row filters and masks of tables named ``<kind>_<flavour>_...``: a filter
    on ``region``, a mask on ``customer_email``, or both."""
    flavour = F.get(F.split("table", "_"), F.lit(1))
    key = ["catalog", "schema", "table"]

    def fn(name: str) -> Column:
        return F.concat_ws(".", "catalog", "schema", F.lit(name))

    filters = tables.where(flavour.isin("rls", "both")).select(
        *key, fn("rf_region").alias("function_fqn"), F.array(F.lit("region")).alias("using_columns"), F.lit("").alias("raw_text")
    )
    masks = tables.where(flavour.isin("mask", "both")).select(
        *key,
        F.lit("customer_email").alias("column"),
        fn("mask_email").alias("function_fqn"),
        F.lit("").alias("raw_text"),
        F.lit(1).alias("position"),
    )
    return filters, masks
