"""The request corpus the registered queries run on.

It is derived row by row from ``events`` by one SQL projection that Spark and
DuckDB both read, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab

# the assistant of the registered queries; requests write its name joined
ASSISTANT = "orbit desk"

_QUERY = """CASE event_id % 24
    WHEN 0 THEN 'Thống kê số lượng trạm 4G ở nation ' || CAST(user_id % 30 AS STRING)
    WHEN 1 THEN 'Dịch vụ ' || event_type || ' là gì?'
    WHEN 2 THEN '/remind me to call ' || event_type
    WHEN 3 THEN 'please /task finish ' || event_type
    WHEN 4 THEN 'the folder contains /tasks for ' || event_type
    WHEN 5 THEN 'schedule /meeting tomorrow'
    WHEN 6 THEN 'Orbitdesk là gì'
    WHEN 7 THEN 'Bạn làm được gì?'
    WHEN 8 THEN 'Số điện thoại của tôi là 09' || LPAD(CAST(user_id AS STRING), 8, '0')
    WHEN 9 THEN 'Thông tin nhân viên ' || LPAD(CAST(event_id AS STRING), 6, '0')
    WHEN 10 THEN 'Tài khoản tungdd' || CAST(user_id % 100 AS STRING) || ' thuộc phòng nào'
    WHEN 11 THEN 'Chất lượng mạng từ ngày ' || CAST(day(ts) AS STRING) || '/' || CAST(month(ts) AS STRING) || '/' || CAST(year(ts) AS STRING)
    WHEN 12 THEN 'Top ' || CAST(1 + user_id % 20 AS STRING) || ' tỉnh có hiệu suất cao hơn 50%'
    WHEN 13 THEN 'Quy trình phê duyệt ' || event_type || ' như thế nào'
    WHEN 14 THEN 'Liệt kê các bước xử lý lỗi ' || event_type
    WHEN 15 THEN 'Báo cáo tổng thể ở region ' || CAST(user_id % 7 AS STRING) || ' hôm nay'
    WHEN 16 THEN 'Đồng chí Đào Duy Tùng là ai'
    WHEN 17 THEN 'đồng chí cho biết doanh thu tháng ' || CAST(1 + user_id % 12 AS STRING) || '/2024'
    WHEN 18 THEN 'remember  the   customer service meeting.. at 17:00'
    WHEN 19 THEN 'Node mạng HLC' || CAST(event_id AS STRING) || 'PCD02 có địa chỉ IP'
    WHEN 20 THEN 'số port băng rộng, số port cố định, trạm LCU' || CAST(user_id AS STRING)
    WHEN 21 THEN 'system network server of the company'
    WHEN 22 THEN 'nation_' || CAST(user_id % 30 AS STRING)
    ELSE 'xyz ' || event_type END"""

_DOMAIN = (
    "CASE event_id % 9 "
    + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(vocab.DOMAINS[:-1]))
    + f" ELSE '{vocab.DOMAINS[-1]}' END"
)

_WORKER = """CASE user_id % 6 WHEN 0 THEN 'FUNCTION_CALLING' WHEN 1 THEN 'DOC_SEARCH'
    WHEN 2 THEN ' REMINDER , DOC_SEARCH,' WHEN 3 THEN 'MEETING'
    WHEN 4 THEN 'DOCS_SEARCHER_AGENT,FUNCTION_CALLER_AGENT' ELSE 'REMINDER_AGENT' END"""

CORPUS = {
    "query_id": "event_id",
    "query": _QUERY,
    "knowledge_domain": _DOMAIN,
    "worker": _WORKER,
}

# dirty variant: the first rule that applies decides
DIRTY = {
    "query_id": "query_id",
    "query": "CASE WHEN query_id % 97 = 0 THEN NULL WHEN query_id % 91 = 0 THEN ''"
             " WHEN query_id % 89 = 0 THEN '   ' ELSE '  ' || query || ' ' END",
    "knowledge_domain": "CASE WHEN query_id % 97 = 0 THEN NULL WHEN query_id % 91 = 0 THEN ''"
                        " WHEN query_id % 89 = 0 THEN knowledge_domain"
                        " WHEN query_id % 83 = 0 THEN ''"
                        " WHEN query_id % 79 = 0 THEN knowledge_domain"
                        " WHEN query_id % 73 = 0 THEN 'NET BI!' ELSE knowledge_domain END",
    "worker": "CASE WHEN query_id % 97 = 0 THEN NULL WHEN query_id % 91 = 0 THEN ''"
              " WHEN query_id % 89 = 0 THEN worker WHEN query_id % 83 = 0 THEN worker"
              " WHEN query_id % 79 = 0 THEN ' , ' WHEN query_id % 73 = 0 THEN worker"
              " WHEN query_id % 71 = 0 THEN 'A*B,REMINDER' ELSE worker END",
}


def projection(columns: dict[str, str]) -> list[str]:
    return [f"{sql} AS {name}" for name, sql in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def request_corpus(events: DataFrame) -> DataFrame:
    return events.selectExpr(*projection(CORPUS))


def dirty_corpus(events: DataFrame) -> DataFrame:
    return request_corpus(events).selectExpr(*projection(DIRTY))
