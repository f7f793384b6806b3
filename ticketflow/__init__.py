"""ticketflow: support-ticket analytics and corpus preparation on PySpark."""
