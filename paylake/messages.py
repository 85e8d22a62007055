"""The credit-transfer message pacs.008: a header and transactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from .functions.validators import amount_between, iban_field, member
from .schema import OPTIONAL, REPEATED, Field, Schema, Segment
from .sources.documents import NAMESPACE

# Codes of the banks that take part.
AGENT_BICS = (
    "HAABSI22;BAKOSI2X;KSPKSI22;SZKBSI2X;GORESI2X;LJBASI2X;KBMASI2X;"
    "SIDRSI22;BACXSI22;HDELSI22;HLONSI22;HKVISI22;BFKKSI22;BSLJSI2X"
)
NAMESPACES = {"": NAMESPACE, "x": NAMESPACE}


def pacs8(header_rule: Callable[[], Column] | None = None, txn_rule: Callable[[], Column] | None = None, bics: str = AGENT_BICS, low: int = 1, high: int = 50_000) -> Schema:
    header = Segment(
        "header", "/x:Document/FIToFICstmrCdtTrf/x:GrpHdr", header=True, rule=header_rule,
        fields=(
            Field("msg_id", "x:GrpHdr/MsgId"),
            Field("no_of_txn", "GrpHdr/NbOfTxs", "big_int"),
            Field("amount_sum", "GrpHdr/TtlIntrBkSttlmAmt", "amount"),
            Field("currency", "GrpHdr/TtlIntrBkSttlmAmt/@Ccy", cardinality=OPTIONAL),
            Field("msg_ts", "x:GrpHdr/CreDtTm", "ts", OPTIONAL),
            Field("value_date", "GrpHdr/IntrBkSttlmDt", "date", OPTIONAL),
        ),
    )
    txn = Segment(
        "txn", "/Document/x:FIToFICstmrCdtTrf/x:CdtTrfTxInf", rule=txn_rule,
        fields=(
            Field("txn_id", "CdtTrfTxInf/PmtId/TxId"),
            Field("debtor_iban", "CdtTrfTxInf/DbtrAcct/Id/IBAN", validator=iban_field()),
            Field("debtor_bic", "CdtTrfTxInf/DbtrAgt/FinInstnId/BICFI", validator=member(bics)),
            Field("creditor_iban", "CdtTrfTxInf/CdtrAcct/Id/IBAN", validator=iban_field()),
            Field("creditor_bic", "CdtTrfTxInf/CdtrAgt/FinInstnId/BICFI", validator=member(bics)),
            Field("amount", "CdtTrfTxInf/IntrBkSttlmAmt", "amount", validator=amount_between(low, high)),
            Field("currency", "CdtTrfTxInf/IntrBkSttlmAmt/@Ccy", cardinality=OPTIONAL),
            Field("instr_agent", "CdtTrfTxInf/InstgAgt/FinInstnId/BICFI", cardinality=REPEATED),
        ),
    )
    return Schema(NAMESPACES, (header, txn))
