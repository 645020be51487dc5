"""The registered jobs and the SQL they are compared with."""
