"""The driver's tables read as a payroll, the registered queries and their SQL counterparts."""
