"""Burns and mints: what the joins move."""

from rivermark.operators import bridge as br


def test_received_messages_are_moved_once(spark):
    got = spark.createDataFrame(
        [("d1", 0, "n1", "r1"), ("d1", 0, "n1", "r2"), ("d2", 0, "n2", "r3"), ("d3", 0, "n2", "r4"), (None, 0, "n3", "r5")],
        "tx_hash string, source_domain int, nonce string, receive_reference string",
    )
    burned = spark.createDataFrame([("n1",), ("n2",), ("n3",), ("n4",)], "nonce string")
    found = br.discover_destination(burned, got)
    rows = {r.nonce: (r.discovery, r.d.receive_reference if r.d else None) for r in found.collect()}
    assert rows == {"n1": ("FOUND", "r1"), "n2": ("AMBIGUOUS", None), "n3": ("FOUND", None), "n4": ("NOT_FOUND", None)}
    assert "Expand" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Aggregate") == 1


def test_attestations_of_a_transaction_meet_its_burns_in_one_join(spark):
    key = "tx_hash string, destination_domain long, burn_token string, mint_recipient string, amount string"
    burned = spark.createDataFrame([("t1", 6, "b", "m", "5"), ("t1", 6, "b", "m", "6"), ("t2", 6, "b", "m", "5"), ("t3", 6, "b", "m", "5"), (None, 6, "b", "m", "5")], key)
    seal = ("complete", "0xab", "1", "00" * 376)
    said = spark.createDataFrame(
        [("t1", 6, "b", "m", "5", *seal), ("t2", 6, "b", "m", "5", *seal), ("t2", 6, "b", "m", "5", *seal), (None, 6, "b", "m", "5", *seal)],
        key + ", status string, attestation string, event_nonce string, attested string",
    )
    out = br.match_attestations(burned, said)
    assert sorted((str(r.tx_hash), r.amount, r.attestation_status) for r in out.collect()) == [
        ("None", "5", "NOT_FOUND"), ("t1", "5", "API_REPORTED_COMPLETE"), ("t1", "6", "NOT_MATCHED"), ("t2", "5", "AMBIGUOUS"), ("t3", "5", "NOT_FOUND"),
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
