"""DataFrame operators for chat ledgers and voucher-code audit records."""
