"""The registered queries: operators over the test tables, with the SQL that checks them."""
