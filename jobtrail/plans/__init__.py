"""The named queries and the SQL that checks them."""
