"""dockflow: bike-share supply and demand analytics as Spark DataFrame operators."""
