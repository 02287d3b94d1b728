"""What of a product an account may use: columns of the snapshot by group. A catalogue is a parameter of the report; this is the default."""

from __future__ import annotations

# Columns of the snapshots, in the order of the report.
CAPABILITIES = {
    "sales channels": ("v_salon", "v_mostrador", "v_delivery", "v_menu_online"),
    "delivery apps": ("v_pedidosya", "v_rappi", "v_ubereats", "v_ifood", "v_didi", "v_justo"),
    "devices": ("ad_pc", "ad_tablet", "ad_mobile"),
    "cash and finance": ("arqueos", "movimientos_caja", "gastos", "cat_gastos", "propinas", "fiscal", "ventas_pagadas_con_mp"),
    "stock and recipes": ("pr_con_stock", "pr_con_costo", "ingredientes", "ing_en_recetas", "notificaciones_por_falta_de_stock", "cantidad_de_proveedores"),
    "customers": ("cantidad_de_clientes", "ventas_con_clientes_asignados", "transacciones_de_cta_cte_de_clientes", "clientes_con_descuentos_automaticos", "descuentos"),
    "online presence": ("menu_online_habilitado", "carta_qr_habilitado", "zonas_de_delivery", "ventas_deli_con_repartidor_asignado"),
    "operation on site": (
        "mesas", "salas", "usuarios_con_pin_asinado", "cantidad_de_cajas", "cantidad_de_turnos", "ventas_con_camarero_o_repartidor", "adiciones_movidas_de_otras_mesas", "productos_favoritos", "ad_lista_de_precio", "ad_combo",
    ),
}
VOLUMES = ("sales_total", "usuarios", "productos", "cantidad_de_clientes", "mesas", "additions_total", "features_in_use", "active_channels", "tenure_months")
SIGNALS = ("sales_total", "features_in_use", "additions_total", "usuarios", "productos", "arqueos", "movimientos_caja", "gastos", "fiscal", "cantidad_de_clientes", "descuentos", "ad_tablet", "pr_con_stock")
