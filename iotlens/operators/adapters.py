"""Protocol extension point: one adapter per protocol name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotlens.operators import decode, vectors


class ProtocolAdapter:
    """Turns capture rows of one protocol into packet events and vectors."""

    name = ""

    def decode(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def features(self, events: DataFrame) -> DataFrame:
        return vectors.behavioral_vector(events)


class MqttAdapter(ProtocolAdapter):
    name = "mqtt"

    def decode(self, rows: DataFrame) -> DataFrame:
        return decode.mqtt_decode(rows)


class CoapAdapter(ProtocolAdapter):
    name = "coap"

    def decode(self, rows: DataFrame) -> DataFrame:
        return decode.coap_decode(rows)


REGISTRY: dict[str, ProtocolAdapter] = {a.name: a for a in (MqttAdapter(), CoapAdapter())}


def decode_all(capture: DataFrame, registry: Mapping[str, ProtocolAdapter] = REGISTRY) -> DataFrame:
    """One filtered branch per protocol; the filter reaches the scan, or its partitions."""
    parts = [a.decode(capture.filter(F.col("protocol") == name)) for name, a in registry.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
