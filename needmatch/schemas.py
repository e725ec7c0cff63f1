"""Schemas of the tables the operators read and write (JSON columns are text)."""

TABLES = {
    "tenants": "tenant_id STRING, name STRING, plan STRING, quotas STRING, settings STRING, metadata STRING, "
               "owner_email STRING, billing_email STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "tenant_usage": "tenant_id STRING, projects_count BIGINT, agents_count BIGINT, api_keys_count BIGINT, "
                    "events_this_month BIGINT, storage_used_mb DOUBLE, last_updated TIMESTAMP",
    "tenant_projects": "tenant_id STRING, project_id STRING, created_at TIMESTAMP",
    "api_keys": "key_id STRING, key_hash STRING, name STRING, prefix STRING, scopes ARRAY<STRING>, tenant_id STRING, "
                "created_at TIMESTAMP",
    "api_key_roles": "key_id STRING, role STRING, projects ARRAY<STRING>",
    "service_accounts": "account_id STRING, name STRING, description STRING, account_type STRING, tenant_id STRING, "
                        "role STRING, allowed_projects ARRAY<STRING>, scopes ARRAY<STRING>, "
                        "keys ARRAY<STRUCT<key_id: STRING, created_at: TIMESTAMP, expires_at: TIMESTAMP, "
                        "last_used: TIMESTAMP, description: STRING>>, created_at TIMESTAMP, updated_at TIMESTAMP, "
                        "created_by STRING, is_active BOOLEAN, last_active TIMESTAMP, total_requests BIGINT",
    "service_account_keys": "key_hash STRING, account_id STRING, key_id STRING",
    "events": "id BIGINT, project_id STRING, tenant_id STRING, data_key STRING, event_type STRING, data STRING, "
              "sequence BIGINT, created_at TIMESTAMP",
    # one row per entry of a snapshot
    "snapshots": "project_id STRING, snapshot_sequence BIGINT, events_replayed BIGINT, data_keys BIGINT, "
                 "data_key STRING, data STRING, sequence BIGINT",
    "embeddings": "project_id STRING, data_key STRING, node_key STRING, node_path STRING, node_type STRING, "
                  "description STRING, data STRING, data_original STRING, data_format STRING, embedding ARRAY<FLOAT>, "
                  "created_at TIMESTAMP, updated_at TIMESTAMP",
    "audit_events": "event_id STRING, timestamp TIMESTAMP, event_type STRING, severity STRING, actor_id STRING, "
                    "actor_type STRING, tenant_id STRING, project_id STRING, resource_type STRING, resource_id STRING, "
                    "action STRING, details STRING, result STRING, request_id STRING, endpoint STRING, method STRING, "
                    "before_state STRING, after_state STRING",
    "webhook_endpoints": "endpoint_id STRING, tenant_id STRING, url STRING, secret STRING, events ARRAY<STRING>, "
                         "categories ARRAY<STRING>, project_ids ARRAY<STRING>, is_active BOOLEAN, timeout_seconds INT, "
                         "max_retries INT, name STRING, description STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "webhook_deliveries": "delivery_id STRING, event_id STRING, endpoint_id STRING, attempt INT, status STRING, "
                          "status_code INT, response_body STRING, error STRING, created_at TIMESTAMP, "
                          "delivered_at TIMESTAMP, duration_ms DOUBLE",
    "rate_limit_entries": "rate_key STRING, request_time TIMESTAMP",
    "agent_registrations": "agent_id STRING, project_id STRING, tenant_id STRING, needs ARRAY<STRING>, "
                           "notification_method STRING, response_format STRING, notification_channel STRING, "
                           "webhook_url STRING, webhook_secret STRING, data_keys ARRAY<STRING>, last_sequence BIGINT, "
                           "last_seen TIMESTAMP, data STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
}
